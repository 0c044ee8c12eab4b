"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case; a document's set
holds its distinct five-word shingles (a shorter text: its whole word sequence; no word: empty, linked
with nothing). Documents are linked when 100 * |A & B| >= percent * |A | B| (85 unless the caller says
otherwise), and classes are the connected components of all links.

1. Equal texts form one node (by a 128-bit digest of the text), so exact copies never meet in pairs.
2. Each text gets band keys of ROWS MinHash values, and an odd sketch: the MinHash samples of SAMPLES
   one-permutation bins, folded into a parity bitmap. The population count of the XOR of two bitmaps
   estimates how many samples differ, most precisely where few do, that is, for high similarities.
3. Texts that share a band key are compared by sketch, in blocks of at most BLOCK texts, so no task holds
   a whole bucket, and only pairs of a block whose estimate comes near the threshold are looked at further: first
   those of a spanning forest, then, once confirmed links have merged most texts, all pairs between
   texts that are still in different classes. So a large group costs few confirmations.
4. The proposed pairs are confirmed on the full sets of 64-bit shingle hashes.

The number of bands and the margin of the estimates follow from the threshold: a pair exactly at it shares no
band with probability MISS at most (24 bands at 85, 38 at 80), and estimates, which err by about 0.02 on long texts
and far less on short ones, may fall short by MARGIN standard errors (0.07 at 85, 0.09 at 80). Within a bucket the sketches
of all texts are compared in numpy, without emitting the pairs, so the work of a bucket of texts that
are similar but not linked grows with its square. So do its rows, M * M / BLOCK of them for M texts, as each
block meets every other; a task's memory does not.

Null and empty texts: n_shingles 0, component_id = doc_id, kept. Null ids: the row belongs to its class, but
gives it no id; kept is false for it unless the class has no id at all. Repeated rows each get the same
answer. Very long texts are hashed whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices, utf8
from tallybook.llm.components import components
from tallybook.session import cut

SHINGLE = 5
PERCENT = 85
ROWS = 6
MISS = 1.2e-5    # probability that a pair at the threshold shares no band
MARGIN = 4.3     # standard errors of an estimate
SAMPLES = 1024   # one-permutation bins whose minima fill the odd sketch
BITS = 1024
BLOCK = 512
CACHE = 1 << 20  # word hashes a task remembers

_STEP = np.random.default_rng(20240301).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def bands(percent: int) -> int:
    return int(np.ceil(np.log(MISS) / np.log1p(-((percent / 100) ** ROWS)))) if percent < 100 else 1


def near(percent: int) -> float:
    """The least estimate of a pair that is looked at further."""
    s = percent / 100
    differ = 2 * SAMPLES * (1 - s)
    flipped = BITS / 4 * -np.expm1(-4 * differ / BITS)  # variance of the differing bits
    slope = 2 * SAMPLES * np.exp(-2 * differ / BITS)    # bits for a unit of similarity
    return s - MARGIN * float(np.sqrt(flipped / slope**2 + s * (1 - s) / SAMPLES))


def min_hashes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the MinHash functions of all bands."""
    rng, size = np.random.default_rng(20240229), bands(percent) * ROWS
    multiply = rng.integers(1, 1 << 32, size, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return multiply, rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most CACHE words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    split = utf8(text or "").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    width = min(SHINGLE, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, width, np.uint64)  # a short sequence never equals a five-word shingle
    for k in range(width):
        total = _mix(total + hashes[k:k + count] * _STEP[k])
    return np.unique(total)


def signature(found: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and odd sketch of a non-empty shingle set."""
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 1024):  # bounded memory for texts of any length
        x = low[start:start + 1024, None] * multiply + add
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(0), out=least)
    keys = np.arange(len(multiply) // ROWS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys + least[r::ROWS].astype(np.uint64) * _STEP[0] + np.uint64(r))
    # `found` is sorted, so the first hash of each value of the top bits is that bin's minimum
    bins, first = np.unique(found >> np.uint64(64 - SAMPLES.bit_length() + 1), return_index=True)
    place = (_mix(found[first] ^ _STEP[1]) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    words, hashes = WordHashes(), min_hashes(percent)
    for batch in batches:
        for piece in text_slices(batch):
            size, bands, sketch, known = [], [], [], {}
            for node, text in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist()):
                if node not in known:
                    found = shingles(text, words)
                    known[node] = (len(found), *(signature(found, *hashes) if len(found) else (None, None)))
                n, b, s = known[node]
                size.append(n), bands.append(b), sketch.append(s)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(size, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["node", "doc_id", "n_shingles", "bands", "sketch"])


def text_node(text: str = "text") -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    rows = docs.select(text_node(text).alias("node"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _signatures(batches, percent),
                           f"node binary, doc_id {kind}, n_shingles long, bands array<long>, sketch binary")


# ---- candidates -----------------------------------------------------------------------------------

def buckets(nodes: DataFrame) -> DataFrame:
    """(band, members): band keys shared by at least two texts; of buckets with the same members, one."""
    keyed = nodes.select(F.explode("bands").alias("band"), F.xxhash64("node").alias("h"))
    full = (keyed.groupBy("band")
            .agg(F.count(F.lit(1)).alias("members"), F.min("h").alias("lo"), F.max("h").alias("hi"),
                 F.bit_xor("h").alias("all")).where("lo != hi"))
    return full.groupBy("members", "lo", "hi", "all").agg(F.min("band").alias("band")).select("band", "members")


def blocks(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """Members of the buckets, each bucket dealt into blocks by hash, and every pair of blocks made one
    group: a row goes to as many groups as its bucket has blocks, and a group has about 2 * BLOCK rows."""
    # the hint keeps the plan of small tables that of large ones
    rows = nodes.select(F.explode("bands").alias("band"), "node").join(full.hint("merge"), "band")
    several = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", several).withColumn("own", F.pmod(F.hash("node", "band"), several))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         "own", "node")


def estimates(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Similarity of each text of a with each of b, from odd sketches (rows of 64-bit words) and set sizes.

    With z of BITS bits differing, about -BITS/2 * ln(1 - 2z/BITS) samples differ. A set of n shingles is
    expected to fill SAMPLES * (1 - exp(-n/SAMPLES)) bins, and of the bins that the union fills the share
    J agrees; a few rounds of fixed-point iteration solve this for J.
    """
    z = np.zeros((len(a), len(b)))
    for w in range(a.shape[1]):
        z += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * z / BITS, 1e-3))
    filled = lambda n: SAMPLES * -np.expm1(-n / SAMPLES)
    agree = np.maximum(filled(na)[:, None] + filled(nb)[None] - differ, 0) / 2
    total = na[:, None] + nb[None]
    est = np.full(z.shape, percent / 100)
    for _ in range(5):
        est = np.minimum(agree / filled(total / (1 + est)), 1)
    small, large = np.minimum(na[:, None], nb[None]), np.maximum(na[:, None], nb[None])
    est[small * 100 < large * percent] = 0  # sizes alone rule the link out
    return est


def _pairs(groups: Iterator[pa.RecordBatch], forest: bool, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each group of one batch."""
    for batch in groups:
        own = np.array(batch.column("own").to_pylist())
        node = batch.column("node").to_pylist()
        n = np.array(batch.column("n_shingles").to_pylist(), float)
        sketch = np.array([np.frombuffer(s, np.uint64) for s in batch.column("sketch").to_pylist()])
        kind = None if forest else np.unique(np.array(batch.column("root").to_pylist(), object),
                                             return_inverse=True)[1]
        first = own == batch.column("i")[0].as_py()
        left = np.flatnonzero(first)
        right = left if batch.column("i")[0] == batch.column("j")[0] else np.flatnonzero(~first)
        if not len(left) or not len(right):
            continue
        est = estimates(sketch[left], n[left], sketch[right], n[right], percent)
        if right is left:
            est[np.tril_indices(len(left))] = 0
        if kind is not None:
            est[kind[left][:, None] == kind[right][None]] = 0
        x, y = np.nonzero(est >= near(percent))
        e = est[x, y]
        x, y = left[x], right[y]
        if kind is not None:
            # a pair is given by the least band key it shares; of buckets with the same members that one stays
            bands = np.array(batch.column("bands").to_pylist())
            shared = np.where(bands[x] == bands[y], bands[x], np.iinfo(np.int64).max).min(1)
            mine = shared == batch.column("band")[0].as_py()
            x, y, e = x[mine], y[mine], e[mine]
        if forest:
            pick = _forest(x, y, e, len(node))
            x, y = x[pick], y[pick]
        yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in x], pa.binary()),
                                          pa.array([node[i] for i in y], pa.binary())], names=["u", "v"])


def _forest(x: np.ndarray, y: np.ndarray, e: np.ndarray, size: int) -> list[int]:
    """Pairs of a spanning forest, the most similar first."""
    root = list(range(size))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    picked = []
    for k in np.argsort(-e, kind="stable"):
        a, b = top(int(x[k])), top(int(y[k]))
        if a != b:
            root[a] = b
            picked.append(int(k))
    return picked


def _group_pairs(group: pa.Table, forest: bool, percent: int) -> pa.Table:
    batch = group.combine_chunks().to_batches()
    out = list(_pairs(iter(batch), forest, percent))
    schema = pa.schema([("u", pa.binary()), ("v", pa.binary())])
    return pa.Table.from_batches(out, schema)


def candidates(members: DataFrame, nodes: DataFrame, forest: bool, roots: DataFrame | None = None,
               percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (u, v) whose sketches look linked: a spanning forest of each group, or all pairs
    between texts of different classes (`roots`: node, root)."""
    facts = nodes.select("node", "n_shingles", "sketch", "bands")
    rows = members
    if roots is not None:
        rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = (rows.groupBy("band", "i", "j").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                 .where("lo != hi").select("band", "i", "j"))
        rows = rows.join(mixed, ["band", "i", "j"])
    rows = rows.join(facts, "node")
    found = (rows.groupBy("band", "i", "j")
             .applyInArrow(lambda group: _group_pairs(group, forest, percent), "u binary, v binary"))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# ---- confirmation -----------------------------------------------------------------------------------

def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        for piece in text_slices(batch):
            sets = [shingles(t, words).tobytes() for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch):
            keep = []
            for a, b in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["u", "v"]).filter(
                pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    return (pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
            .mapInArrow(lambda batches: _confirm(batches, percent), "u binary, v binary"))


def row_key() -> Column:
    return F.concat_ws(":", F.hex("node"), F.col("doc_id").cast("string"))


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, set) of the texts in `wanted` (node, doc_id of one of its rows), one row each.

    Rows meet by node and id, so the copies of a text are dealt over all tasks and only one of them is hashed.
    The hint keeps the plan of small tables that of large ones.
    """
    rows = docs.select(text_node(text).alias("node"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("node", "text", row_key().alias("key"))
    keys = wanted.select(row_key().alias("key"))
    chosen = (rows.join(keys.hint("merge"), "key", "left_semi").select("node", "text")
              .mapInArrow(_sets, "node binary, set binary"))
    return chosen.groupBy("node").agg(F.first("set").alias("set"))


# ---- classes ----------------------------------------------------------------------------------------

def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: node, doc_id, n_shingles, component_id, kept. `percent` is the least similarity
    of a link."""
    signed = cut(signatures(docs, doc_id, text, percent))
    filled = signed.where("n_shingles > 0")
    nodes = cut(filled.select("node", "n_shingles", "bands", "sketch").dropDuplicates(["node"]))
    full = cut(buckets(nodes))
    members = cut(blocks(nodes, full))
    copies = cut(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    near = members.select("node").distinct().join(copies, "node")
    # every text that shares a bucket may have to be confirmed; its set is made once
    first = cut(candidates(members, nodes, forest=True, percent=percent))
    sets = cut(shingle_sets(docs, near, doc_id, text))
    links = cut(confirmed(first, sets, percent))
    roots = cut(components(links))
    rest = candidates(members, nodes, forest=False, roots=roots, percent=percent)
    links = links.unionByName(confirmed(rest, sets, percent))
    roots = components(links)
    named = copies.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    named = cut(named)
    whole = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = named.join(whole, "root").select("node", "component_id")
    out = signed.select("node", "doc_id", "n_shingles").join(
        known.withColumnRenamed("node", "known"),
        (F.col("node") == F.col("known")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("node", "doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))


def one_of_each(docs: DataFrame, columns: list[str], percent: int = PERCENT) -> DataFrame:
    """The given columns of one document of each class. Repeated rows of it stay once; rows without id
    stay only where their class has no id."""
    chosen = classes(docs, percent=percent).where("kept").select(row_key().alias("__key"))
    rows = (docs.select(*columns, text_node().alias("node"))
            .withColumn("__key", row_key()).drop("node"))
    # one shuffle of the texts serves both the join and the removal of repeated rows
    return rows.join(chosen, "__key", "left_semi").dropDuplicates(["__key"]).select(*columns)
