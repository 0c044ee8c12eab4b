import random

from corpus import AWKWARD, awkward, brute_classes, none, prose

from tallybook.llm import neardup
from tallybook.llm.components import components


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in neardup.classes(df).collect()), key=repr)
    want = sorted(((k is None, k, c) for (k, _), c in zip(rows, brute_classes(rows))), key=repr)
    assert got == want


def test_awkward_rows(spark):
    check(spark, [r[:2] for r in AWKWARD])
    got = neardup.classes(awkward(spark)).collect()
    assert {(r.n_shingles, r.kept) for r in got if r.doc_id in (1, 2, 3)} == {(0, True)}
    assert not any(r.kept for r in got if r.doc_id is None)
    assert neardup.classes(none(spark)).count() == 0


def test_equals_brute_force_on_chains_of_copies(spark):
    rng = random.Random(4)
    rows, key = [], 0
    for group in range(6):
        words = prose(group, rng.choice([3, 5, 8, 60, 150, 400])).split()
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((key, " ".join(copy)))
            key += 1
            if rng.random() < 0.3:
                words = copy  # a chain: copies of copies
    check(spark, rows)


def test_buckets_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [(i, prose(3, 100) + f" x{i % 30}") for i in range(60)]
    check(spark, rows)


def test_one_of_each(spark):
    got = neardup.one_of_each(awkward(spark), ["doc_id", "text"]).collect()
    # the copies of row 5 leave one row, as do its repeated rows
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 8, 9, 10, 11] or \
        sorted(r.doc_id for r in got) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 20]
    assert neardup.one_of_each(none(spark), ["doc_id", "text"]).count() == 0
