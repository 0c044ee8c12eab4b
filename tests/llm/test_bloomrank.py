import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import AWKWARD, CLASH, awkward, none, prose
from pyspark.sql import functions as F

from tallybook.llm import bloomrank as br


def words(text):
    low = re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return Counter(re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low))


def brute(docs, items, k=10):
    held = [(key, words(t)) for key, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in held:
            if c and key is not None:
                m = 100 - 75 + (75 * sum(c.values()) * n) // total
                scores.append((-sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                                    * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w, r in words(text).items() if w in c), key))
        out += [(item, place, key, -s) for place, (s, key) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "Alpha1 beta2 beta2 gamma3 delta4"), (2, None), (3, ""), (4, "unheardof wordsonly"), (5, prose(1, 40)), (5, prose(1, 40)),
         (6, "naïve FAÇADE façade \U0001F600 changed"), (7, "ALPHA1 " * 500), (8, prose(99, 3000))]


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    extra = [(100 + k, prose(k, rng.choice([1, 5, 40, 400]))) for k in range(150)] + [(100, prose(0, 5)), (900, "alpha1 " * 300)]
    docs = awkward(spark).select("doc_id", "text", *CLASH).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", *[F.lit("").alias(c) for c in CLASH]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("clash"))
    want = brute([r[:2] for r in AWKWARD] + extra, [i for n, i in enumerate(ITEMS) if i not in ITEMS[:n]])
    assert sorted(map(tuple, br.rank(docs, items).collect())) == want
    monkeypatch.setattr(br, "BLOCK", 7)
    monkeypatch.setattr(br, "CHUNK", 50)      # several passes over the index
    assert sorted(map(tuple, br.rank(docs, items).collect())) == want
    monkeypatch.setattr(br, "BITS", 1)        # signatures that say yes nearly always: looser bounds, same result
    assert sorted(map(tuple, br.rank(docs, items).collect())) == want


def test_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert br.rank(none(spark), items).count() == 0
    assert br.rank(awkward(spark), items.where("false")).count() == 0


@pytest.mark.parametrize("bits", [1, 8])
def test_bounds_hold_and_prune(monkeypatch, bits):
    monkeypatch.setattr(br, "BITS", bits)
    rng = random.Random(4)
    found = [br._hashes(Counter(f"w{int(rng.paretovariate(0.7))}".encode() for _ in range(rng.choice([3, 30, 300])))) for _ in range(200)]
    row = br._row("x", list(range(200)), found)
    n, total = row["n_docs"][0].as_py(), row["n_terms"][0].as_py()
    block = br.Block({c: row[c][0].as_py() for c in row.schema.names}, n, total)
    asked = np.unique(np.concatenate([h for h, _ in found]))[:500]
    which = np.arange(0, len(asked), 7)
    weights = np.array([rng.randrange(1, 9000) for _ in which])
    local = np.searchsorted(block.words, asked)
    bounds = block.bounds(asked, [(which, weights)])[0]
    exact = np.array([block.score(d, local[which], weights) for d in range(200)])
    assert (bounds >= exact).all()
    if bits == 8:   # most documents that the term numbers rule out are ruled out by the signatures
        assert (bounds >= np.sort(exact)[-10]).sum() < 40
