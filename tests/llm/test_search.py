import math
from collections import Counter

import numpy as np
import pyarrow as pa
from corpus import AWKWARD, WORDS, awkward, bm25_words, none, prose

from tallybook.llm import ann, bm25
from tallybook.llm.registered import queries

SF = "/root/testdata/sf0.001"


def brute_bm25(rows, every=20, k=bm25.TOP, terms=bm25.TERMS):
    rows = [(i, bm25_words(t)) for i, t in rows if i is not None]
    n = len(rows)
    mean = sum(sum(w.values()) for _, w in rows) / n
    df = Counter(w for _, ws in rows for w in ws)
    idf = {w: math.log1p((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = sum((ws for i, ws in rows if i == q), Counter())
        picked = sorted(own, key=lambda w: (-own[w] * idf[w], w))[:terms]
        scored = []
        for i, ws in rows:
            parts = [idf[w] * (bm25.K1 + 1) * ws[w] / (ws[w] + bm25.K1 * (1 - bm25.B + bm25.B * sum(ws.values()) / mean))
                     for w in picked if w in ws]
            if parts and i != q:
                scored.append((-round(math.fsum(parts), 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())


def test_bm25_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 37)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    rng = np.random.default_rng(3)
    weight = np.arange(len(WORDS), 0, -1) / np.arange(len(WORDS) + 1).sum()
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(0, 60)), p=weight))) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(5)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(bm25.search(docs)) == brute_bm25(rows)
    monkeypatch.setattr(bm25, "QUERIES", 7)
    assert rows_of(bm25.search(docs, k=3, terms=5)) == brute_bm25(rows, k=3, terms=5)


def test_wand_skips_and_stays_exact():
    rng = np.random.default_rng(5)
    for _ in range(50):
        cursors, total = [], Counter()
        for _ in range(int(rng.integers(1, 6))):
            docs = np.sort(rng.choice(500, int(rng.integers(1, 300)), replace=False)).astype("<i4")
            tfs = rng.integers(1, 9, len(docs)).astype(float)
            lengths = rng.integers(5, 200, len(docs)).astype(float)
            c = bm25.Cursor(float(rng.uniform(0.1, 5)), docs, tfs, lengths, docs.astype("<i8"), 80.0)
            cursors.append(c)
            for d, s in zip(c.docs, c.scores):
                total[d] += s
        want = sorted((-round(s, 9), d) for d, s in total.items() if d != 3)[:7]
        got = sorted((-round(s, 9), d) for s, d in bm25.wand(cursors, 7, 3))
        assert got == want


def test_bm25_asks_with_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 150)
    monkeypatch.setattr(bm25, "CHUNK", 3)
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(900)]
    weight = 1 / np.arange(1, 901)
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(30, 250)), p=weight / weight.sum()))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = rows_of(bm25.search(docs))
    assert got == brute_bm25(rows, terms=None) != brute_bm25(rows, terms=12)
    assert rows_of(bm25.search(docs, terms=12)) == brute_bm25(rows, terms=12)


def test_op7_asks_with_the_whole_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_bm25([tuple(r) for r in docs], terms=None)
    got = rows_of(queries()["op7_bm25"](spark, SF))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=0, atol=2e-9)


def test_unread_words_change_nothing(monkeypatch):
    rng = np.random.default_rng(12)
    n, reads = 2000, []
    sums = bm25.Lists.sums
    monkeypatch.setattr(bm25.Lists, "sums", lambda self, words: reads.append(int(self.sizes[words].sum())) or sums(self, words))
    sizes = np.array([int(rng.integers(2, 12)) for _ in range(60)] + [int(rng.integers(200, 1500)) for _ in range(40)])
    docs = np.concatenate([np.sort(rng.choice(n, s, replace=False)) for s in sizes])
    scores = np.concatenate([rng.uniform(4, 9, s) if s < 20 else rng.uniform(0.01, 0.1, s) for s in sizes])
    ids = rng.permutation(n)
    want = sorted((-round(s, 9), ids[d]) for d, s in enumerate(np.bincount(docs, scores, n)) if ids[d] != 3)[:10]
    lists = bm25.Lists(docs, scores, sizes, ids)
    assert sorted((-round(s, 9), d) for s, d in lists.best(np.arange(100), 10, 3)) == want
    assert sum(reads) < sizes.sum() / 2


def test_rows_of_a_query_do_not_grow_with_the_shards(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD", 10)
    matches, made = bm25.matches, []
    monkeypatch.setattr(bm25, "matches", lambda *a: made.append(matches(*a)) or made[-1])
    rng = np.random.default_rng(17)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 40))))) for i in range(400)]  # 40 shards
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    assert rows_of(bm25.search(docs)) == brute_bm25(rows)
    assert made[0].count() <= bm25.TOP * bm25.PARTS * 20


def test_floors_and_blocks_lose_nothing():
    rng = np.random.default_rng(19)
    n = 900
    sizes = np.array([int(rng.integers(2, 40)) for _ in range(80)] + [int(rng.integers(60, 800)) for _ in range(40)])
    docs = np.concatenate([np.sort(rng.choice(n, s, replace=False)) for s in sizes])
    scores = rng.uniform(0.1, 5, len(docs))
    scores[rng.random(len(docs)) < 0.01] += 90  # a few documents far ahead, so that floors leave few blocks
    ids = rng.permutation(n)
    lists = bm25.Lists(docs, scores, sizes, ids)
    of = np.repeat(np.arange(len(sizes)), sizes)
    queries = [np.sort(rng.choice(len(sizes), int(rng.integers(1, 100)), replace=False)) for _ in range(60)]
    own = rng.choice(n, 60).tolist()
    want = []
    for words, q in zip(queries, own):
        held = np.isin(of, words)
        totals = np.bincount(docs[held], scores[held], n)
        want.append(sorted((-round(t, 9), i) for t, i in zip(totals.tolist(), ids.tolist()) if t > 0 and i != q)[:10])
    rounded = lambda found: [[(round(s, 9), i) for s, i in f] for f in found]
    assert rounded(lists.best_of(queries, 10, own, [0.0] * 60)) == want
    floors = [-w[4][0] if len(w) > 4 else 0.0 for w in want]
    got = rounded(lists.best_of(queries, 10, own, [f - 1e-8 if f else f for f in floors]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert sorted(lists.alike(queries).tolist()) == list(range(60))


def test_index_holds_every_word():
    texts = ["", None, "One two, TWO", "naïve—ÉTÉ x1", "  ", "one" + "\x00" + "two", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for piece in (batch, batch.slice(2, 3), batch.slice(0, 2)):
        row, = [r.to_pylist()[0] for r in bm25._index(iter([piece]))]
        found = bm25._binary(row["words"], row["ends"]).to_pylist()
        sizes, docs, tfs, ids = (np.frombuffer(row[c], t) for c, t in (("sizes", "<i4"), ("docs", "<u2"), ("tfs", "<u2"), ("ids", "<i8")))
        got = [{} for _ in ids]
        for word, d, t in zip(np.repeat(np.array(found, object), sizes), docs.tolist(), tfs.tolist()):
            got[d][word] = t
        want = dict(zip(*piece.to_pydict().values()))
        assert {int(i): g for i, g in zip(ids, got)} == {i: dict(bm25_words(t)) for i, t in want.items()}
        assert row["total"] == sum(sum(bm25_words(t).values()) for t in want.values())


def test_bm25_awkward(spark):
    got = bm25.search(awkward(spark))
    assert rows_of(got) == brute_bm25([r[:2] for r in AWKWARD])
    assert bm25.search(none(spark)).count() == 0


def brute_nearest(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i, tuple(v)] = np.array(v, float)
    out = []
    for (q, key), v in good.items():
        if q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for (i, _), w in good.items() if i != q)[:k]
            out += [(q, r + 1, i, round(-s, 12)) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_hilbert_visits_neighbours():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = ann.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_ann_awkward_rows_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    # 32-bit values whose products are exact, so that every order of summation agrees
    rows = [(i, [float(x) for x in rng.integers(-8, 9, 8)]) for i in range(150)]
    rows += [(i, rows[40][1]) for i in range(200, 240)]  # many copies of one vector
    rows += [(300, None), (320, []), (340, [0.0] * 8), (360, [1.0] * 7), (380, [float("nan")] * 8),
             (400, [float("inf")] + [1.0] * 7), (420, [None] + [1.0] * 7), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as node")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in ann.search(df).collect())
    assert got == brute_nearest(rows)
    assert ann.search(df.where("false")).count() == 0
    assert ann.search(df.where("vec_id = 20")).count() == 0


def test_ann_recall_in_windows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_WINDOW", 20)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 10)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=8)).astype("f4").tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.search(df).collect()}
    want = {(q, i) for q, _, i, _ in brute_nearest(rows)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_prose_is_repeatable():
    assert prose(1, 5) == prose(1, 5)
