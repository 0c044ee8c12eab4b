"""Approximate nearest neighbours by inner product along several shifted Hilbert curves.

Vectors are projected, once per curve, to a few random directions, their coordinates made even by quantiles
of a bounded sample, shifted, and numbered along a Hilbert curve. Spark range-partitions each curve's keys, and
each query takes as candidates the rows in a window around its own place on every curve. Candidates are scored
in double precision on the original vectors and the curves' results merged.

For inner products, vectors get one more coordinate that makes their lengths equal (zero for queries, which
are scaled to the largest length), so that near on a curve means a large product.

The window is a share of the rows on either side (at least LEAST_WINDOW rows), because on vectors without any
cluster structure, as in the given table, no window of fixed size keeps its recall as the table grows.

Rows take no part when the id or vector is null, the vector is empty, zero, holds null or non-finite
components, or differs in length from most vectors. Rows that repeat id and vector count once. Equal vectors
are one point on the curves that carries its K + 1 smallest ids, enough for any answer, so copies don't
crowd a window out; ties go to the smaller id. With fewer candidates than K all are returned. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.session import cut

K = 20
CURVES = 20
DIRECTIONS = 8
BITS = 7
WINDOW = 0.026        # of the rows, on either side
LEAST_WINDOW = 200
SAMPLE = 10_000       # vectors whose quantiles make the coordinates even
BLOCK = 4096          # rows of a curve that a task compares at once
QUERIES = 4096        # queries that meet a block in one task, about
QUANTILES = 256


def hilbert(coords: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of whole coordinates below 2**bits) along the Hilbert curve.

    Gray-code form: undo the curve's rotations from the highest bit down, then read the coordinates'
    bits in turn.
    """
    x = [c.astype(np.int64) for c in coords.T]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        below = bit - 1
        for i in range(len(x)):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & below)
            x[i] = x[i] ^ swap
            x[0] = np.where(flip, x[0] ^ below, x[0] ^ swap)
        bit >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (((c ^ turn) >> b) & 1)
    return key


class Curves:
    """Directions, quantiles and shifts of all curves, from a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int = CURVES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest = longest
        size = sample.shape[1] + 1
        directions = min(DIRECTIONS, size)
        lifted = self.lift(sample)
        self.project, self.cuts, self.shift = [], [], []
        for _ in range(curves):
            rotation = np.linalg.qr(rng.standard_normal((size, size)))[0][:, :directions]
            self.project.append(rotation)
            self.cuts.append(np.quantile(lifted @ rotation, np.arange(1, QUANTILES) / QUANTILES, axis=0))
            self.shift.append(rng.uniform(0, 1 / 3, directions))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.column_stack((x, rest)) / self.longest

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        y = lifted @ self.project[curve]
        even = np.stack([np.searchsorted(c, v) for c, v in zip(self.cuts[curve].T, y.T)], 1) / QUANTILES
        placed = (even + self.shift[curve]) * 0.75 * (1 << BITS)
        return hilbert(np.minimum(placed, (1 << BITS) - 1), BITS)


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (array<double>) and node (16 bytes that stand for the vector) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vec")).where(
        "vec_id is not null and vec is not null and size(vec) > 0")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(fine & F.exists("vec", lambda v: v != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (common["n"] if common else 0))
    node = F.unhex(F.md5(F.concat_ws(",", F.transform("vec", lambda v: (v + F.lit(0.0)).cast("string")))))
    return rows.withColumn("node", node)


def _keyed(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            piece = batch.slice(start, 2048)
            x = np.array(piece.column(1).to_pylist())
            lifted = {0: curves.lift(x)}
            asked = np.array(piece.column(3).to_pylist())
            if asked.any():
                lifted[1] = curves.query(x[asked])
            raw = pa.array([v.tobytes() for v in x], pa.binary())
            for curve in range(len(curves.project)):
                for kind, points_ in lifted.items():
                    chosen = pa.array(asked) if kind else pa.array(np.ones(len(x), bool))
                    n = len(points_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, curve, np.int32)), pa.array(curves.keys(points_, curve)),
                         pa.array(np.full(n, kind, np.int32)), piece.column(0).filter(chosen),
                         piece.column(2).filter(chosen), raw.filter(chosen)],
                        names=["curve", "key", "kind", "node", "least", "vec"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and how many data rows of the curve stand before in the partition."""
    part = TaskContext.get().partitionId()
    seen: dict[int, int] = {}
    for batch in batches:
        curve = batch.column("curve").to_numpy()
        data = batch.column("kind").to_numpy() == 0
        place = np.empty(len(curve), np.int64)
        for c in np.unique(curve):
            at = curve == c
            place[at] = np.cumsum(data[at]) - data[at] + seen.get(int(c), 0)
            seen[int(c)] = seen.get(int(c), 0) + int(data[at].sum())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(curve), part, np.int32)), pa.array(place)],
            names=[*batch.schema.names, "part", "place"])


def _nearest(data: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    schema = pa.schema([("query", pa.binary()), ("node", pa.binary()), ("least", pa.int64()), ("score", pa.float64())])
    if not data.num_rows or not asked.num_rows:
        return schema.empty_table()
    data = data.sort_by("rank")
    rank = data["rank"].to_numpy()
    x = np.array([np.frombuffer(v) for v in data["vec"].to_pylist()])
    node, least = data["node"].to_pylist(), data["least"].to_numpy()
    q = np.array([np.frombuffer(v) for v in asked["vec"].to_pylist()])
    lo = np.searchsorted(rank, asked["lo"].to_numpy())
    hi = np.searchsorted(rank, asked["hi"].to_numpy())
    out: list[list] = [[], [], [], []]
    for j, name in enumerate(asked["node"].to_pylist()):
        a, b = lo[j], hi[j]
        if a >= b:
            continue
        score = (x[a:b] * q[j]).sum(1)  # each product on its own, so equal vectors get equal scores
        best = np.arange(len(score))
        if len(score) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            best = np.flatnonzero(score >= edge)
        best = best[np.lexsort((least[a:b][best], -score[best]))][:k]
        out[0] += [name] * len(best)
        out[1] += [node[a + i] for i in best]
        out[2] += least[a:b][best].tolist()
        out[3] += score[best].tolist()
    return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema)


def search(vectors: DataFrame, every: int = 20, k: int = K, curves: int = CURVES,
           window: float = WINDOW) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id is divisible by `every`."""
    rows = cut(points(vectors).dropDuplicates(["vec_id", "node"]))
    order = Window.partitionBy("node").orderBy("vec_id")
    ids = (rows.select("node", "vec_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
           .groupBy("node").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = F.col("vec_id") % every == 0
    same = rows.groupBy("node").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("least"),
                                    F.max(asked).alias("asked"))
    same = cut(same.join(ids, "node"))
    facts = same.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda s, v: s + v * v)).alias("longest"), F.count_if("asked").alias("queries")).first()
    if not facts["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r["vec"] for r in same.select("vec").where(
        F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 1.2 * SAMPLE / facts["n"])))
        .limit(SAMPLE).collect()])
    made = Curves(sample, math.sqrt(facts["longest"]), curves)
    reach = max(LEAST_WINDOW, math.ceil(window * facts["n"]))
    schema = "curve int, key long, kind int, node binary, least long, vec binary"
    keyed = same.select("node", "vec", "least", "asked").mapInArrow(partial(_keyed, curves=made), schema)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    placed = cut(keyed.repartitionByRange(parts, "curve", "key", "kind", "node")
                 .sortWithinPartitions("curve", "key", "kind", "node")
                 .mapInArrow(_numbered, schema + ", part int, place long"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("curve", "part").agg(F.count_if(F.col("kind") == 0).alias("n"))
              .select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    ranked = placed.join(starts, ["curve", "part"]).withColumn("rank", F.col("place") + F.col("start"))
    meet = max(1, math.ceil(facts["queries"] * (2 * reach + BLOCK) / facts["n"] / QUERIES))
    data = (ranked.where("kind = 0").select(
        "curve", "rank", "node", "least", "vec", F.floor(F.col("rank") / BLOCK).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(meet - 1))).alias("deal")))
    last = (facts["n"] - 1) // BLOCK
    wanted = cut(ranked.where("kind = 1").select(
        "curve", "node", "vec", (F.col("rank") - reach).alias("lo"), (F.col("rank") + reach).alias("hi"),
        F.pmod(F.hash("node"), F.lit(meet)).alias("deal"))
        .withColumn("block", F.explode(F.sequence(
            F.greatest(F.floor(F.col("lo") / BLOCK), F.lit(0)),
            F.least(F.floor((F.col("hi") - 1) / BLOCK), F.lit(last))))))
    found = (data.groupBy("curve", "block", "deal").cogroup(wanted.groupBy("curve", "block", "deal"))
             .applyInArrow(lambda a, b: _nearest(a, b, k + 1), "query binary, node binary, least long, score double"))
    merged = found.groupBy("query", "node", "least").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    top = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    top = top.join(same.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    queries = rows.where(asked).select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(top, "query").where("query_id != vec_id")
    final = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
