"""Small awkward tables and brute-force versions shared by the tests."""

import random
import re
import zlib
from collections import Counter

WORDS = "alpha beta gamma delta river stone cloud paper house light green window sound metal".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


LONG = prose(99, 60_000)
BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)

# doc_id, text, lang, source, n_chars, then columns whose names clash with results
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4), (4, "Two words", "en", "a", 9),
    (5, BASE, "en", "a", None), (5, BASE, "en", "a", None), (6, NEAR, "fr", "b", 1), (7, BASE.upper(), "en", "a", 1),
    (None, BASE, None, None, None), (8, "12345 !!! ...", "en", "a", 1), (9, LONG, "fr", "c", len(LONG)),
    (10, prose(2, 300), "fr", "c", 1), (11, "naïve — façade \U0001F600 \U00020000", "fr", "c", 1), (20, BASE + " tail end", "en", "a", 1),
]
CLASH = ["score", "rank", "node", "lang_pred", "label", "length", "offset", "predicted", "rate", "body", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def none(spark):
    return awkward(spark).where("false")


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    """[(doc_id, text)] -> component id per row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(rows):
        if not sets[i]:
            out.append(key)
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and top(j) == top(i) and rows[j][0] is not None]
        out.append(min(ids, default=None))
    return out


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def bm25_words(text):
    return Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()))
