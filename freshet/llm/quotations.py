"""Quotation linking: quoted passages find the messages they come from and leave reply-ordered conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from freshet.functions.ordering import global_ordinal
from freshet.functions.series import salted_lookup
from freshet.llm.common import BLANKS, one_blank
from freshet.session import materialize

MARK = r"^(?:[\x20\t]*>)+"
ATTRIBUTION = r"^.{1,200} wrote:$"
SENTENCE_END = "(?<=[.!?]) |(?<=[。！？])"


def _normal(text: Column) -> Column:
    return F.lower(F.btrim(one_blank(text)))


def _passages(lines: Column) -> Column:
    """Maximal runs of worded lines of one level: array of (level, text), in order."""
    empty = F.array().cast("array<struct<level:int,text:string>>")
    last = lambda runs: F.element_at(runs, -1)

    def add(runs, line):
        joined = F.concat(
            F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))),
            F.array(F.struct(line["level"].alias("level"), F.concat_ws(" ", last(runs)["text"], line["text"]).alias("text"))),
        )
        begun = F.concat(runs, F.array(F.struct(line["level"].alias("level"), line["text"].alias("text"))))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["level"] == line["level"])
        return F.when(F.btrim(line["text"], F.lit(BLANKS)) == "", runs).when(same, joined).otherwise(begun)

    return F.aggregate(lines, empty, add)


def parse(messages: DataFrame) -> DataFrame:
    """Each message's lines with their quote level, its own text, and its passages by level."""
    marks = lambda x: F.regexp_extract(x, MARK, 0)
    lines = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\r?\n"),
        lambda x: F.struct(
            (F.length(marks(x)) - F.length(F.replace(marks(x), F.lit(">"), F.lit("")))).cast("int").alias("level"),
            F.when(marks(x) == "", x).otherwise(F.ltrim(F.substring(x, F.length(marks(x)) + 1, F.length(x)))).alias("text"),
        ),
    )
    parsed = messages.withColumn("lines", lines)
    own = F.filter(
        "lines",
        lambda x, i: (x["level"] == 0)
        & ~(
            F.btrim(x["text"], F.lit(BLANKS)).rlike(ATTRIBUTION)
            & F.coalesce(F.get(F.col("lines"), i + 1)["level"] > 0, F.lit(False))
        ),
    )
    quoted = F.filter("lines", lambda x: x["level"] > 0)
    return parsed.withColumns({
        "own_text": F.btrim(F.array_join(F.transform(own, lambda x: x["text"]), "\n"), F.lit(BLANKS)),
        "n_quoted_lines": F.size(quoted).cast("bigint"),
        "quote_levels": F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("bigint"),
        "passages": F.filter(_passages(F.col("lines")), lambda x: x["level"] > 0),
        # other levels end a passage like blank lines
        "quoted_text": F.array_join(F.transform("lines", lambda x: F.when(x["level"] == 1, x["text"]).otherwise("")), "\n"),
    })


def _units(text: Column, *more: Column) -> Column:
    """What is compared of a text: the whole, its paragraphs, lines and sentences, and `more` strings, normalised."""
    parts = F.transform(F.concat(F.array(text), F.split(text, r"\n[\x20\t]*\n"), F.split(text, "\n"), *more), _normal)
    sentences = F.flatten(F.transform(parts, lambda x: F.transform(F.split(x, SENTENCE_END), lambda y: F.btrim(y))))
    return F.filter(F.array_distinct(F.concat(parts, sentences)), lambda x: x != "")


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per row of `messages` (conv_id, turn, role, text), without quotes and in reply order.

    A line's level is its number of leading `>` marks. Level-1 passages and the own texts of messages
    are taken apart into paragraphs, lines and sentences, which are normalised (lower case, blanks
    collapsed) and hashed, so that excerpts are found too. The parent is the message before it in its
    conversation that holds most of these units, the latest of equals; deeper levels are parsed and removed, as they repeat what the parent quotes. Messages that
    quote nothing known begin a thread. A thread follows its root, its messages by turn, so that
    every parent precedes its replies; `position` counts from 0 in a conversation. An attribution
    line ("... wrote:") before a quote goes with it.

    Hashes of 64 bits are joined with the length of the passage. Null text is empty; null
    conversations form one conversation and null turns come first in it; rows with the same
    conversation and turn share parents and are ordered by role and text. Other columns are ignored.
    """
    base = messages.select(
        "conv_id", "turn", "role", "text",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
        F.col("conv_id").isNull().alias("c_null"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("t"),
    )
    parsed = materialize(parse(base).drop("lines").withColumn("row", F.monotonically_increasing_id()))
    key = ["c_null", "c", "hash", "size"]
    hashed = [F.xxhash64("p").alias("hash"), F.length("p").alias("size")]
    runs = F.transform(F.filter("passages", lambda x: x["level"] == 1), lambda x: x["text"])
    quotes = parsed.where(F.size(runs) > 0).select("c_null", "c", "t", F.explode(_units(F.col("quoted_text"), runs)).alias("p"))
    wanted = materialize(quotes.select("c_null", "c", "t", *hashed).distinct())
    held = parsed.join(wanted.select("c_null", "c").distinct(), ["c_null", "c"], "left_semi").select(
        "c_null", "c", "t", F.explode(_units(F.col("own_text"))).alias("p")
    )
    originals = held.select("c_null", "c", F.col("t").alias("parent"), *hashed).distinct()
    matched = wanted.join(originals, key).where("parent < t").groupBy("c_null", "c", "t", "parent").agg(F.count(F.lit(1)).alias("n"))
    parents = materialize(matched.groupBy("c_null", "c", "t").agg(F.max_by("parent", F.struct("n", "parent")).alias("parent")))
    at = ["c_null", "c", "t"]
    roots = parents.select(*at, F.col("parent").alias("root"))
    while True:
        further = roots.select("c_null", "c", F.col("t").alias("root"), F.col("root").alias("next"))
        step = materialize(
            roots.join(further, ["c_null", "c", "root"], "left")
            .select(*at, F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    known = parsed.join(parents, at, "left").join(roots, at, "left").withColumn("root", F.coalesce("root", "t"))
    placed = global_ordinal(known, ["c_null", "c", "root", "t", "role", "own_text", "row"], "place")
    first = placed.groupBy("c_null", "c").agg(F.min("place").alias("first"))
    numbered = salted_lookup(placed, first, ["c_null", "c"], ["row"], "inner")
    return numbered.select(
        "conv_id", "turn", "role", F.col("own_text").alias("text"), "n_quoted_lines", "quote_levels",
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"),
        (F.col("place") - F.col("first")).cast("bigint").alias("position"),
    )


ORACLE = r"""
WITH RECURSIVE ln AS (
  SELECT conv_id, turn, i, regexp_extract(line, '^(?:[ \t]*>)+') AS mark, line
  FROM (
    SELECT conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i
    FROM (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations))),
lv AS (
  SELECT conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level,
         CASE WHEN mark = '' THEN line ELSE ltrim(substr(line, length(mark) + 1), ' ') END AS body
  FROM ln),
nx AS (SELECT *, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next_level FROM lv),
own AS (
  SELECT conv_id, turn, trim(string_agg(body, chr(10) ORDER BY i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own_text
  FROM nx
  WHERE level = 0 AND NOT (regexp_matches(trim(body, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), '^.{1,200} wrote:$') AND coalesce(next_level > 0, false))
  GROUP BY conv_id, turn),
agg AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted_lines, max(level) AS quote_levels FROM lv GROUP BY conv_id, turn),
worded AS (SELECT * FROM lv WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
islands AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run
  FROM worded),
quotes AS (
  SELECT conv_id, turn, lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY i), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS p
  FROM islands WHERE level = 1 GROUP BY conv_id, turn, level, run),
parts AS (
  SELECT conv_id, turn, unnest(list_concat([own_text], regexp_split_to_array(own_text, '\n[ \t]*\n'), string_split(own_text, chr(10)))) AS part
  FROM own),
originals AS (
  SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(part, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS p FROM parts),
parents AS (
  SELECT q.conv_id, q.turn, max(o.turn) AS parent
  FROM quotes q JOIN originals o ON q.conv_id = o.conv_id AND q.p = o.p AND o.turn < q.turn AND o.p <> '' GROUP BY q.conv_id, q.turn),
up AS (
  SELECT conv_id, turn, turn AS root FROM conversations
  UNION
  SELECT up.conv_id, up.turn, p.parent FROM up JOIN parents p ON up.conv_id = p.conv_id AND up.root = p.turn),
roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, coalesce(own.own_text, '') AS text, n_quoted_lines, quote_levels::BIGINT AS quote_levels,
       parent AS parent_turn, root AS root_turn, row_number() OVER (PARTITION BY c.conv_id ORDER BY root, c.turn) - 1 AS position
FROM conversations c
LEFT JOIN own ON own.conv_id = c.conv_id AND own.turn = c.turn
JOIN agg ON agg.conv_id = c.conv_id AND agg.turn = c.turn
LEFT JOIN parents ON parents.conv_id = c.conv_id AND parents.turn = c.turn
JOIN roots ON roots.conv_id = c.conv_id AND roots.turn = c.turn
"""
