"""Mix documents to target weights over domains with soft memberships, in DataFrame operations only.

1. A naive Bayes classifier over words, hashed to BUCKETS numbers, learns from the labelled rows and gives every document a
   probability for each domain (its membership), so a text of two domains counts for both.
2. Nonnegative rates are fitted by projected gradient descent on the squared difference between each
   domain's expected tokens, sum(rate * tokens * membership), and its target, starting at rate 1 for all.
   Each step is one aggregate of one row over the written memberships: only the domains' sums, a few
   numbers, reach the driver, and a document's rate is a column expression over them.
   It goes on until the targets are met or no step brings them nearer; what then remains is the column `excess`,
   with a warning, or with `strict` an error.
   With `keep_all` rates are projected to 1 and more, so every row comes out, and the total grows as far as that needs.
3. A rate becomes whole copies: its integer part, and one more if a hash of the document falls below its
   fraction. So the same rows are chosen at every run and on every retry.

A null or empty text has no tokens: its membership is the domains' prior, and as it changes
no total it keeps rate 1. Rows without a label teach nothing; domains without a target share have target 0
(with `keep_all` their present share); targets are scaled to 1 (to what those shares leave). Repeated rows are treated alike. Without any labelled row there are no domains and
every rate is 1. A null id hashes like the text. Texts of any length are read whole. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.session import cut

BUCKETS = 2048     # numbers that words are hashed to
EVIDENCE = 4       # words that a longer text's evidence counts for, so that mixed texts stay mixed
MAX_DOMAINS = 200  # the classifier is a set of literals of this many rows
PRECISION = 1e-4   # of all tokens
MISSED = 1e-3      # excess from which targets count as missed
LEAST_GAIN = 1e-3  # share by which a step must bring the targets nearer
MOST_STEPS = 500   # a guard against endless fits only; the excess tells what is left
RIDGES = (0.0, 1e-3, 1e-2, 1e-1)
LENGTHS = (1, 8, 64)
MOST_GROWTH = 2    # with `keep_all`, times what pure domains would need


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns in `keep`, then __tokens (number of white-space separated words) and __words (the
    numbers of all of them)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")
    number = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    return (docs.select(*keep, once(words.alias("__w")))
            .select(*keep, F.size("__w").cast("long").alias("__tokens"), F.transform("__w", number).alias("__words")))


def once(*columns: Column) -> Column:
    """The columns as a generator of one row: the planner then works them out once instead of copying their
    expressions to each place that uses them."""
    return F.inline(F.array(F.struct(*columns)))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _sum_of(known: Column) -> Column:
    return F.aggregate("__words", F.lit(0.0), lambda s, w: s + F.get(known, w))


class Domains:
    """Names, logarithms of the priors, and weights of the words of the classifier."""

    def __init__(self, names: list[str], prior: np.ndarray, weight: np.ndarray):
        self.names, self.prior, self.weight = names, prior, weight

    def evidence(self) -> list[Column]:
        """The logarithm of each domain's probability, but for a constant, from __words and __tokens."""
        weigh = F.lit(float(EVIDENCE)) / F.greatest(F.col("__tokens"), F.lit(EVIDENCE))
        out = []
        for row, p in zip(self.weight, self.prior):
            # one constant array; written as text, as it is sent to the planner in one piece that way
            known = F.split(F.lit(",".join(f"{w:.6g}" for w in row)), ",").cast("array<double>")
            out.append(_sum_of(known) * weigh + F.lit(float(p)))
        return out


def learn(rows: DataFrame, domain: str) -> Domains:
    """Word frequencies and share of rows of each domain, from measured rows with a label. At most BUCKETS
    counts for each domain reach the driver."""
    known = rows.where(F.col(domain).isNotNull()).withColumn("domain", F.col(domain).cast("string"))
    got = known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").limit(MAX_DOMAINS + 1).collect()
    if len(got) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names = [r["domain"] for r in got]
    counts = np.ones((len(names), BUCKETS))
    words = known.select("domain", F.explode("__words").alias("w")).groupBy("domain", "w").agg(
        F.count(F.lit(1)).alias("n"))
    for r in words.collect():
        counts[names.index(r["domain"]), r["w"]] += r["n"]
    share = np.log(counts / counts.sum(1, keepdims=True))
    weight = share - share.mean(0) if len(names) else share
    rows_each = np.array([r["n"] for r in got], float)
    return Domains(names, np.log(rows_each / max(rows_each.sum(), 1)), weight)


def with_memberships(rows: DataFrame, domains: Domains) -> DataFrame:
    """Adds __p, the memberships in the order of the domains' names."""
    if not domains.names:
        return rows.withColumn("__p", F.array().cast("array<double>"))
    names = [f"__e{k}" for k in range(len(domains.names))]
    rows = rows.select("*", once(*[e.alias(n) for n, e in zip(names, domains.evidence())]))
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    likely = [F.exp(F.col(n) - top) for n in names]
    return (rows.select("*", once(F.array(*likely).alias("__l")))
            .select("*", once(F.transform("__l", lambda x: x / total(
                F.col("__l")[k] for k in range(len(names)))).alias("__p")))
            .drop("__l", *names))


def _vector(numbers) -> str:
    return f"array({', '.join(f'{float(x)!r}D' for x in numbers)})"


def _less(before: Column, step: Column, least: float) -> Column:
    """The rate after one more step, projected."""
    dot = F.aggregate(F.zip_with("__p", step, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.greatest(F.lit(least), before - dot)


def rate(steps: list[np.ndarray], least: float = 0.0) -> Column:
    """The rate of a document after these steps, each a change per unit of membership; one constant, however many."""
    if not steps:
        return F.lit(1.0)
    made = F.aggregate(F.expr(f"array({', '.join(map(_vector, steps))})"), F.lit(1.0), lambda r, s: _less(r, s, least))
    return F.when(F.col("__tokens") > 0, made).otherwise(F.lit(1.0))


def fit_rates(rows: DataFrame, domains: Domains, targets: dict[str, float], keep_all: bool = False,
              precision: float = PRECISION, most_growth: float = MOST_GROWTH) -> tuple[list[np.ndarray], float]:
    """Projected gradient steps on rows with __tokens and __p, and the largest excess of a domain's share that stays.

    The total number of tokens stays, or, with `keep_all`, grows; see `growth`.
    A document's gradient is its tokens times sum(p_d * excess_d). Dividing by the tokens (steps in the
    metric that weighs documents by tokens) leaves the same optimum and moves all documents alike. Steps are tried
    together in one aggregate and the best one is taken: plain ones, one over the largest eigenvalue long and
    longer, the first of which is always a descent; and ones scaled by the inverse, with several ridges, of the memberships'
    token-weighted second moments over the documents above the least rate, the first of which reaches the targets at
    once where it cuts no rate. The fit ends when the targets are met or no step gains LEAST_GAIN.
    """
    k = len(domains.names)
    if not k:
        return [], 0.0
    weights = np.array([max(0.0, targets.get(n, 0.0)) for n in domains.names])
    given = np.array([n in targets for n in domains.names])
    if not weights.sum():
        raise ValueError("no target names a domain of the labelled rows")
    least = float(keep_all)
    p, t = F.col("__p"), F.col("__tokens").cast("double")
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def moments(steps: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Second moments of the documents above the least rate, and the tokens at rate 1."""
        above = F.when((rate(steps, least) > least) | F.lit(not steps), t).otherwise(0.0)
        got = rows.select("__p", t.alias("__t"), above.alias("__a")).agg(
            F.sum("__t").alias("t"), *[F.sum(F.col("__a") * p[a] * p[b]).alias(f"m{a}_{b}") for a, b in pairs]).first()
        second = np.zeros((k, k))
        for a, b in pairs:
            second[a, b] = second[b, a] = got[f"m{a}_{b}"] or 0.0
        return second, got["t"] or 0.0

    def tokens(steps: list[np.ndarray], tried: list[np.ndarray]) -> np.ndarray:
        """Expected tokens of each domain after each of the tried steps."""
        made = rows.where("__tokens > 0").select("__p", t.alias("__t"), rate(steps, least).alias("__r"))
        made = made.select("__p", *[(_less(F.col("__r"), F.expr(_vector(x)), least) * F.col("__t")).alias(f"t{i}")
                                    for i, x in enumerate(tried)])
        got = made.agg(*[F.sum(F.col(f"t{i}") * p[d]).alias(f"s{i}_{d}") for i in range(len(tried)) for d in range(k)]).first()
        return np.array([[got[f"s{i}_{d}"] or 0.0 for d in range(k)] for i in range(len(tried))])

    second, total = moments([])
    if not total:
        return [], 0.0
    second, goal = second / total, weights / weights.sum()
    share = second.sum(1)  # at rate 1: E[p_a] = sum over b of E[p_a p_b]
    if keep_all:
        goal = np.where(given, goal * share[given].sum(), share)
        goal = goal * growth(second, goal, most_growth)
    longest = np.linalg.eigvalsh(second)[-1]
    done: list[np.ndarray] = []
    excess = share - goal

    def size(x: np.ndarray) -> float:
        return math.sqrt(float((x**2).sum()))

    while size(excess) > precision and len(done) < MOST_STEPS:
        tried = [np.linalg.pinv(second + q * longest * np.eye(k), rcond=1e-6) @ excess * part
                 for q in RIDGES for part in (1, 0.3)] + [excess / longest * n for n in LENGTHS]
        gaps = tokens(done, tried) / total - goal
        best = int(np.argmin([size(g) for g in gaps]))
        if size(gaps[best]) > (1 - LEAST_GAIN) * size(excess):
            break
        done.append(tried[best])
        excess = gaps[best]
        if size(excess) > precision:
            second = moments(done)[0] / total
    return done, float(np.abs(excess).max())


def growth(second: np.ndarray, goal: np.ndarray, most: float = MOST_GROWTH) -> float:
    """How many times the tokens must grow so that every document keeps a rate of 1 or more.

    Pure domains need the largest ratio of share to goal. Mixed ones need more, as what raises one raises others: so
    much that the weights of the domains that give the goal are all 1 or more. Where that is more than `most` times
    the first, or no such weights exist (domains that the classifier can't tell apart), the first it is.
    """
    wanted = goal > 0
    pure = max(1.0, float((second.sum(1)[wanted] / goal[wanted]).max()))
    exact = np.linalg.pinv(second, rcond=1e-6) @ goal
    reached = exact.min() > 0 and np.abs(second @ exact - goal).max() <= PRECISION
    return float(1 / exact.min()) if reached and 1 / exact.min() <= most * pure else pure


def copies(key: list[str]) -> Column:
    """Whole copies for the column `rate`: its integer part and a fair, repeatable choice for the rest."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, domain: str, targets: dict[str, float], teach: Column | None = None,
        keep_all: bool = False, strict: bool = False, most_growth: float = MOST_GROWTH) -> DataFrame:
    """doc_id, tokens, membership (map from domain to probability), rate, excess (the largest gap between a domain's
    share of the expected tokens and its target, the same for all rows), copies for every row.

    `domain` names the label column, `teach` says which rows may be learned from (default: all). Targets missed
    by more than MISSED give a warning, or with `strict` a ValueError.
    """
    rows, domains, (steps, excess) = prepared(docs, domain, targets, teach, keep_all, strict, most_growth)
    named = (F.map_from_arrays(F.array(*map(F.lit, domains.names)), F.col("__p")) if domains.names
             else F.create_map().cast("map<string,double>"))
    return (rows.select("doc_id", F.col("__tokens").alias("tokens"), named.alias("membership"),
                        rate(steps, float(keep_all)).alias("rate"), F.lit(excess).alias("excess"), "__hash")
            .withColumn("copies", copies(["doc_id", "__hash"])).drop("__hash"))


def prepared(docs: DataFrame, domain: str, targets: dict[str, float],
             teach: Column | None = None, keep_all: bool = False, strict: bool = False,
             most_growth: float = MOST_GROWTH) -> tuple[DataFrame, Domains, tuple[list[np.ndarray], float]]:
    """Written memberships of every row, the classifier, and the fitted steps with their excess."""
    narrow = docs.select("doc_id", "text", F.col(domain).alias("__domain"),
                         (F.lit(True) if teach is None else teach).alias("__teach"),
                         F.xxhash64("text").alias("__hash"))
    base = cut(measured(narrow, ["doc_id", "__domain", "__teach", "__hash"]))
    domains = learn(base.where("__teach"), "__domain")
    rows = cut(with_memberships(base, domains).select("doc_id", "__tokens", "__p", "__hash"))
    fitted = fit_rates(rows, domains, targets, keep_all, most_growth=most_growth)
    if fitted[1] > MISSED:
        text = f"targets are missed: a domain's share is {fitted[1]:.4f} off"
        if strict:
            raise ValueError(text)
        warnings.warn(text)
    return rows, domains, fitted


def mixed(docs: DataFrame, domain: str, targets: dict[str, float], columns: list[str],
          keep_all: bool = False, strict: bool = False, most_growth: float = MOST_GROWTH) -> DataFrame:
    """The documents themselves, each as often as its copies say; memberships are worked out again from
    the text, so texts aren't shuffled."""
    _, domains, (steps, _) = prepared(docs, domain, targets, None, keep_all, strict, most_growth)
    rows = with_memberships(measured(docs, list(dict.fromkeys([*columns, "doc_id", "text"]))), domains).select(
        "*", once(rate(steps, float(keep_all)).alias("rate")))
    rows = rows.withColumn("__hash", F.xxhash64("text"))
    rows = rows.withColumn("__copies", copies(["doc_id", "__hash"])).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*columns)
