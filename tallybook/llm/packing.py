"""Pack tokenised documents into as few sequences of fixed capacity as possible.

Each document is tokenised whole, an end token is added, and only longer ones are cut: the first piece
takes what is left over, all further ones fill a sequence each. Since lengths are whole numbers up to the
capacity, the packing problem is described by the number of pieces of each length, at most `capacity`
numbers. The driver packs that histogram, in bulk; Spark then numbers the pieces of each length and looks up
each one's sequence and offset. No piece goes through the driver.

Large-item matching: of pieces above a third of the capacity at most two fit into a sequence, so they are
paired greedily, the largest first, each with the largest partner that still fits; the smaller pieces then
go, longest first, into the fullest sequence that still holds them (best fit).

A null text is empty: one piece holding the end token alone. Repeated rows are packed each for itself. Ties
between equal lengths are broken by id, piece and ids; among fully equal rows any order gives the same
result rows. An empty table gives no rows. Other columns are ignored, and texts of any length are read whole.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices
from tallybook.session import cut

CAPACITY = 1024
END = 2


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path, without ending, of a vocabulary that lies there both as .json and as .tiktoken ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


class Encoder:
    """Token ids as the `tokenizers` file gives them.

    Ordinary texts are encoded from the same vocabulary's ranks, which is several times faster; texts with
    characters beyond Latin or with a special token's string go through the file itself, as the two libraries
    needn't agree there.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(f"{path}.json")
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.careful = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, special)])).search

    def __call__(self, text: str) -> list[int]:
        if self.careful(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = Encoder(path)
    for batch in batches:
        for part in text_slices(batch, 128):
            doc, piece, start, length, ids = [], [], [], [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = np.array([*encode(text or ""), END], "<u4")
                first = len(tokens) % capacity or capacity
                at = [0, *range(first, len(tokens), capacity), len(tokens)]
                for k, (lo, hi) in enumerate(zip(at, at[1:])):
                    doc.append(key), piece.append(k), start.append(lo), length.append(hi - lo)
                    ids.append(tokens[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, part.schema.field(0).type), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids: token ids as little-endian unsigned 32-bit numbers."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_pieces, path=path or vocabulary(), capacity=capacity),
                           f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank + 1, first sequence, offset) that place every piece.

    The pieces of a length with ranks lo to hi - 1 go, in order, to sequences seq, seq + 1, ... at that
    offset. Sequences that look alike are handled together, as runs of neighbouring numbers.
    """
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    used: Counter = Counter()      # pieces of a length that are placed
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}   # free space -> runs of sequences (first, count)
    sequences = 0

    def place(size: int, first: int, count: int, offset: int) -> None:
        runs.append((size, used[size], used[size] + count, first, offset))
        used[size] += count
        left[size] -= count
        if offset + size < capacity:
            gaps.setdefault(capacity - offset - size, []).append((first, count))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            # the largest partner that fits beside it
            k = bisect.bisect_right(large, capacity - size) - 1
            while k >= 0 and left[large[k]] <= (1 if large[k] == size and left[size] == 1 else 0):
                k -= 1
            first = sequences
            if k < 0:
                count = left[size]
                sequences += count
                place(size, first, count, 0)
            elif large[k] == size:
                count = left[size] // 2
                sequences += count
                place(size, first, count, 0)
                gaps[capacity - size].pop()
                place(size, first, count, size)
            else:
                count = min(left[size], left[large[k]])
                sequences += count
                place(size, first, count, 0)
                gaps[capacity - size].pop()
                place(large[k], first, count, size)
    free = sorted(g for g in gaps if gaps[g])
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            k = bisect.bisect_left(free, size)
            if k == len(free):
                # the rest opens new sequences, each holding as many as fit
                count = -(-left[size] // (capacity // size))
                first, sequences = sequences, sequences + count
                insert, gap = [(first, count)], capacity
            else:
                gap = free[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    free.pop(k)
                insert = [(first, count)]
            take = min(count, left[size])
            if take < insert[0][1]:
                rest = (insert[0][0] + take, count - take)
                if gap < capacity:
                    if not gaps.get(gap):
                        bisect.insort(free, gap)
                    gaps.setdefault(gap, []).append(rest)
            after = gap - size
            had = bool(gaps.get(after))
            place(size, first, take, capacity - gap)
            if after and not had:
                bisect.insort(free, after)
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of `cut_pieces` (needs doc_id, piece, length), with sequence_id and offset.

    The pieces of a length are numbered in groups by a hash of the id, so that a length many pieces share
    is spread over all tasks; the groups' sizes are summed up to give each group its first number.
    """
    spark = cut_pieces.sparkSession
    groups = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = cut(rows.groupBy("length", "__group").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    histogram = {r["length"]: r["n"] for r in
                 sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    placed = spark.createDataFrame(
        plan(histogram, capacity) or [(0, 0, 0, 0, 0)],
        "length long, __lo long, __hi long, __seq long, __offset long")
    within = Window.partitionBy("length", "__group").orderBy("doc_id", "piece", *(
        c for c in ("start", "ids_crc32") if c in cut_pieces.columns))
    ranked = (rows.withColumn("__n", F.row_number().over(within) - 1)
              .join(starts, ["length", "__group"])
              .withColumn("__rank", F.col("__n") + F.col("__first")))
    # the plan has a few runs for each possible length, whatever the number of pieces
    found = ranked.join(F.broadcast(placed), (ranked["length"] == placed["length"])
                        & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return found.select(*[ranked[c] for c in cut_pieces.columns],
                        (F.col("__seq") + F.col("__rank") - F.col("__lo")).alias("sequence_id"),
                        F.col("__offset").alias("offset"))


def digests(cut_pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids, written once: packing reads them twice."""
    return cut(cut_pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
