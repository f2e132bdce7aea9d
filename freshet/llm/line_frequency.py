"""Quality rules with the frequency of lines across the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.series import salted_lookup
from freshet.llm.common import BLANKS, one_blank, words
from freshet.session import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 3


def normal_line(line: Column) -> Column:
    return F.lower(F.btrim(one_blank(line)))


def line_frequency(
    docs: DataFrame,
    host: str = "source",
    min_documents: int = 10,
    max_share: float = 0.1,
    min_left: float = 0.3,
    with_text: bool = False,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, host): rule statistics, removed lines and the verdict.

    Lines are split at line feeds, normalised (lower case, blanks collapsed) and hashed to 64 bits. A
    line is boilerplate in its host when more than max(`min_documents`, `max_share` of the host's
    documents) different documents hold it; documents of a host with equal texts count once, since
    copies are the work of exact deduplication. A document is depleted when the words left after
    removing boilerplate are fewer than `min_left` of its words. `kept` is false for depleted
    documents and for those that fail the base rules (fewer than 50 words, or more than half of the
    words in repeated windows of three).

    Null text is the empty text, null hosts form one host, repeated rows each get their own row, other
    columns are ignored. An empty table gives an empty table. `with_text` adds `clean_text`, the text
    without boilerplate lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.col(host).isNull().alias("no_host"),
        text.alias("text"),
        words(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("worded"),
    )
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW),
            lambda i: F.struct(
                F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")
            ),
        )
    )
    hashed = split.select(
        "row", "doc_id", "host", "no_host", "text",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"),
        F.transform(
            F.split("text", "\n"),
            lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.size(words(x)).alias("words")),
        ).alias("lines"),
        F.when(F.size("words") < WINDOW, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(windows).alias("windows"),
    )
    seen_twice = F.filter(
        "windows",
        lambda x, i: F.coalesce(F.get(F.col("windows"), i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(F.col("windows"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    placed = hashed.withColumn("repeats", F.sort_array(F.transform(seen_twice, lambda x: x["i"]))).drop("windows")
    # each repeated window adds the words that the repeated window before it did not cover
    covered = F.aggregate(
        F.transform(
            F.col("repeats"),
            lambda x, i: F.least(F.lit(WINDOW), x - F.coalesce(F.get(F.col("repeats"), i - 1), F.lit(-WINDOW))),
        ),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    facts = placed.withColumn("n_repeat_words", covered).drop("repeats")
    facts = materialize(facts if with_text else facts.drop("text"))

    at = ["no_host", "host", "line"]
    lines = facts.select("row", "no_host", "host", "text_hash", F.posexplode("lines").alias("pos", "at")).select(
        "row", "no_host", "host", "text_hash", "pos", "at.line", "at.words"
    ).where("words > 0")
    held_by = lines.select(*at, "text_hash").distinct().groupBy(*at).agg(F.count(F.lit(1)).alias("documents"))
    sizes = (
        facts.select("no_host", "host", "text_hash").distinct()
        .groupBy("no_host", "host").agg(F.count(F.lit(1)).alias("host_documents"))
    )
    common = held_by.where(F.col("documents") > min_documents)
    boilerplate = (
        salted_lookup(common, sizes, ["no_host", "host"], ["line"], "inner")
        .where(F.col("documents") > F.col("host_documents") * F.lit(max_share))
        .select(*at)
    )
    removed = (
        salted_lookup(lines, boilerplate, at, ["row"], "inner")
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.collect_set("pos").alias("removed_lines"))
    )
    judged = facts.join(removed, "row", "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)).cast("bigint")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < F.col("n_words") * F.lit(min_left)
    out = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words",
        *([_without(F.col("text"), F.col("removed_lines")).alias("clean_text")] if with_text else []),
    )
    return out


def _without(text: Column, positions: Column) -> Column:
    gone = F.coalesce(positions, F.array().cast("array<int>"))
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS w3
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w3) AS n FROM g) WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, text, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, source, text, unnest(ls) AS line FROM d)),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE n > 0 GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT text) AS host_documents FROM d GROUP BY source),
boiler AS (
  SELECT f.source, f.norm
  FROM (SELECT source, norm, count(DISTINCT text) AS documents FROM ln WHERE n > 0 GROUP BY source, norm) f
  JOIN host h ON f.source IS NOT DISTINCT FROM h.source
  WHERE documents > 10 AND documents > host_documents * 0.1::DOUBLE),
gone AS (
  SELECT l.doc_id, sum(l.n) AS removed_words
  FROM ln l JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm WHERE l.n > 0 GROUP BY l.doc_id),
s AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < n_words * 0.3::DOUBLE) AS kept,
       removed_words
FROM s
"""
