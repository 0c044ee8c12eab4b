import numpy as np
import pytest
from corpus import AWKWARD, awkward, none

from tallybook.llm import mixing


def test_tokens_and_words(spark):
    texts = [None, "", "  ", "a b", "\n a\tb  c ", "É é ß", "the The THE"]
    got = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = mixing.measured(got, ["text"]).collect()
    assert [r["__tokens"] for r in rows] == [len((t or "").split()) for t in texts]
    for t, r in zip(texts, rows):
        assert len(r["__words"]) == r["__tokens"] and all(0 <= w < mixing.BUCKETS for w in r["__words"])
        assert len(set(r["__words"])) == len(set((t or "").lower().split()))


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    kinds = {"x": "aaab aab abab", "y": "zzyx zyz xyzz", "z": "mnom onmn mono"}
    rows = [(i, " ".join(rng.choice(kinds[k].split(), int(rng.integers(5, 200)))), k)
            for i, k in enumerate(rng.choice(list("xyz"), 400, p=[0.7, 0.2, 0.1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    targets = {"x": 0.3, "y": 0.3, "z": 0.4}
    got = mixing.mix(docs, "kind", targets).collect()
    total = sum(r.tokens * r.rate for r in got)
    assert np.isclose(total, sum(r.tokens for r in got), rtol=1e-3)
    for k, share in targets.items():
        assert abs(sum(r.tokens * r.rate * r.membership[k] for r in got) / total - share) < 2e-3
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    kept = mixing.mix(docs, "kind", targets, keep_all=True).collect()
    assert min(r.rate for r in kept) > 0.99
    assert mixing.mixed(docs, "kind", targets, ["doc_id"], keep_all=True).select("doc_id").distinct().count() > 395


def test_keep_all_drops_no_row(spark):
    rng = np.random.default_rng(7)
    kinds = {"x": "aaab aab abab", "y": "zzyx zyz xyzz", "z": "mnom onmn mono"}
    every = [w for k in kinds.values() for w in k.split()]
    rows = []
    for i, k in enumerate(rng.choice(list("xyz"), 900, p=[0.8, 0.1, 0.1])):
        n = int(rng.integers(5, 100))  # one word in ten of any domain, so that memberships are mixed
        rows.append((i, " ".join(rng.choice(every if rng.random() < 0.1 else kinds[k].split()) for _ in range(n)), str(k)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    for targets in ({"x": 0.4, "y": 0.3, "z": 0.3}, {"x": 0.5, "y": 0.5}):
        out = mixing.mixed(docs, "kind", targets, ["doc_id"], keep_all=True)
        assert {r.doc_id for r in out.collect()} == set(range(900))
        got = mixing.mix(docs, "kind", targets, keep_all=True).collect()
        assert min(r.rate for r in got) >= 1
        tokens = sum(r.tokens for r in got)
        now = {k: sum(r.tokens * r.membership[k] for r in got) / tokens for k in kinds}
        rest = sum(now[k] for k in targets)
        total = sum(r.tokens * r.rate for r in got)
        for k in kinds:
            want = targets[k] * rest if k in targets else now[k]
            assert abs(sum(r.tokens * r.rate * r.membership[k] for r in got) / total - want) < 2e-3


def test_growth_out_of_reach():
    alike = np.outer([0.8, 0.2], [0.8, 0.2])  # every document has the same memberships
    assert np.isclose(mixing.growth(alike, np.array([0.2, 0.8])), 4)


def rows_with(spark, p, tokens):
    rows = spark.createDataFrame([([float(x) for x in v], int(t)) for v, t in zip(p, tokens)],
                                 "__p array<double>, __tokens long")
    return rows, mixing.Domains(list("xyz")[:p.shape[1]], None, None)


def made_rates(p, steps, least):
    r = np.ones(len(p))
    for s in steps:
        r = np.maximum(least, r - p @ s)
    return r


def least_squares(p, t, goal, least, rounds=100_000):
    """Plain projected gradient in NumPy; the smallest distance found."""
    r = np.ones(len(p))
    length = np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    for _ in range(rounds):
        gap = (r * t) @ p - goal
        if np.abs(gap).max() < 1e-7:
            break
        r = np.maximum(least, r - p @ gap / length)
    return np.linalg.norm(gap)


@pytest.mark.parametrize("goal, least", [((0.3, 0.3, 0.4), 0), ((0.9, 0.1, 0.0), 0), ((0.02, 0.97, 0.01), 0),
                                         ((0.5, 0.25, 0.25), 1)])
def test_rates_are_as_near_as_brute_force(spark, goal, least):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.dirichlet((30, 1, 1), 80), rng.dirichlet((1, 9, 1), 25), rng.dirichlet((0.2, 0.2, 6), 15), np.eye(3)])
    tokens = rng.integers(1, 300, len(p)).astype(float)
    rows, domains = rows_with(spark, p, tokens)
    steps, excess = mixing.fit_rates(rows, domains, dict(zip("xyz", goal)), bool(least))
    r = made_rates(p, steps, least)
    shares = (r * tokens) @ p / tokens.sum()
    want = np.array(goal) * (shares.sum() if least else 1)
    assert r.min() >= least and np.isclose(excess, np.abs(shares - want).max(), atol=1e-3)
    near = least_squares(p, tokens / tokens.sum(), want, least)
    assert np.linalg.norm(shares - want) <= near + 1e-3


def test_missed_targets_are_said(spark):
    docs = spark.createDataFrame([(i, "same words in all", "p" if i % 4 else "q") for i in range(40)],
                                 "doc_id long, text string, kind string")
    for keep_all in (False, True):
        with pytest.warns(UserWarning, match="missed"):
            got = mixing.mix(docs, "kind", {"p": 0.1, "q": 0.9}, keep_all=keep_all).collect()
        assert len(got) == 40 and {r.excess > 0.1 for r in got} == {True}
        assert min(r.rate for r in got) >= keep_all
        with pytest.raises(ValueError, match="missed"):
            mixing.mix(docs, "kind", {"p": 0.1, "q": 0.9}, keep_all=keep_all, strict=True)


def test_zero_target_cuts_rates_at_zero(spark):
    docs = spark.createDataFrame([(i, "aaa ab" if i % 2 else "zzz zy", "p" if i % 2 else "q") for i in range(40)],
                                 "doc_id long, text string, kind string")
    got = mixing.mix(docs, "kind", {"p": 1.0}).collect()
    assert all(r.rate >= 0 for r in got)
    assert sum(r.rate for r in got if r.doc_id % 2 == 0) < 0.2 * sum(r.rate for r in got if r.doc_id % 2)
    with pytest.raises(ValueError):
        mixing.mix(docs, "kind", {"other": 1.0})


def test_awkward_rows(spark):
    got = mixing.mix(awkward(spark), "lang", {"en": 1, "fr": 1}).collect()
    assert len(got) == len(AWKWARD)
    assert all(r.rate == 1 and r.copies == 1 for r in got if r.doc_id in (1, 2, 3))
    assert all(abs(sum(r.membership.values()) - 1) < 1e-9 for r in got)
    assert mixing.mix(none(spark), "lang", {"en": 1}).count() == 0
    assert mixing.mixed(none(spark), "lang", {"en": 1}, ["doc_id", "text"]).count() == 0
    unlabelled = awkward(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.rate for r in mixing.mix(unlabelled, "lang", {"en": 1}).collect()} == {1.0}
