"""Small corpora with the awkward cases every operator has to stand, and brute-force versions."""

import collections

import pandas as pd

SF_DIR = "/root/testdata/sf0.001"
# Columns whose names clash with what operators make on the way.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, words string, hash string, rep string, "
    "part string, length string, kept string, score string, ids string, label string, target string, prefix string, n string"
)
STORY = " ".join(f"word{k % 97} and {k}" for k in range(120))


def awkward(spark):
    """Null ids, texts and hosts, empty and long texts, ties, and repeated rows."""
    texts = [
        (1, "one two three four five six", "en", "a"), (2, "one two three four five six", "en", "a"),
        (3, "one  two\nthree four five six", "en", "b"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t ", "en", "a"),
        (7, STORY, "en", "a"), (8, STORY + " tail", "en", None), (9, "x " * 30_000, "en", "a"), (10, "y" * 50_000, "en", "a"),
        (11, "Ünï çödé ñandú 漢字 ½ ² é 👩‍👩‍👧", "es", "a"), (11, "Ünï çödé ñandú 漢字 ½ ² é 👩‍👩‍👧", "es", "a"),
        (None, "no id here", "en", "a"), (12, STORY, "en", "a"), (12, "same id, other text", "en", "a"),
        (13, "<|endoftext|> token = abc\x0bdef\x1cghi", "en", "a"),
    ]
    rows = [(i, t, la, s, len(t or ""), 0, "w", "h", "r", "p", "l", "k", "s", "i", "l", "t", "p", "n") for i, t, la, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def frame(df) -> pd.DataFrame:
    return df.toPandas()


def shingle_sets(rows, words=5):
    out = []
    for _, text in rows:
        w = [x for x in (text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")]
        w = [y for x in w for y in x.split("\t") if y]
        w = [y for x in w for y in x.replace("\r", "\n").split("\n") if y]
        out.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def linked(rows, threshold=0.8):
    """Number of links of every row, and the smallest id of its connected group, by comparing all pairs."""
    sets = shingle_sets(rows)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) >= threshold * len(a | b)):
                n[i], n[j] = n[i] + 1, n[j] + 1
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    return [(d, n[i], min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)]
