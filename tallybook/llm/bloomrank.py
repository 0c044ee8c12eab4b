"""Rank documents for given texts: bit-sliced Bloom signatures bound the scores, candidates are scored exactly.

Index: documents are gathered in blocks of BLOCK rows, ordered by their number of signature keys. A document's keys are its
terms, and each term again for every TIERS step its frequency reaches. Documents of a block whose key counts lie between the
same powers of two form a class with signatures of one length, BITS bits for each key of the fullest, HASHES bits set a
key. A class is stored in slices: for each signature bit the bitmap of its documents. Beside them lie the block's
exact term numbers and frequencies, for the statistics and for scoring.

Search: for a term the slices of its bits are intersected, which gives every document that holds it and a few that
don't. Presence at a tier bounds the frequency from above, and with the document's known length the term's share of
the score. The weighted sums of these bitmaps, tier by tier, are upper bounds of all scores of a block.
A document is scored exactly unless its bound is below the k-th best exact score met so far by the task, so nothing is left
out that could be among the best. Tasks hand over at most k rows an item, and Spark merges them.

Score (64-bit integers, divisions rounding down): N documents have a term, L is their number of terms, n a document's, tf
and df as usual. A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), a document has m = 25 + 75 n N div L, and the
score sums w (10^9 tf div (1000 tf + 8 m)) over the item's terms with their repeats.

Items go to the tasks in chunks of about CHUNK terms, each a pass over the index; their statistics are all the driver
sees. Terms are told apart by 64-bit hashes. Null and empty texts hold no terms and are never found; rows without id count
in the statistics, but are not returned. Repeated rows are documents of their own. Equal scores go to the smaller doc_id.
Rows of an item's id count together, repeated texts once; an item without a term that occurs gives no rows, as do empty
tables. Texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices, utf8
from tallybook.session import cut

TOP = 10
BLOCK = 1024
BLOCK_ENTRIES = 2_000_000      # distinct terms of a block's documents, at most about
BITS = 8
HASHES = 4
TIERS = (1, 2, 4, 8)           # a key for each step that a term's frequency reaches
FULL = 1_000_000               # no term's share of the score, over its weight, reaches this
CHUNK = 200_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # one a tier


def terms(text: str | None) -> Counter:
    return Counter(_TERM.findall(utf8(text or "").lower()))


def _places(hashes: np.ndarray, tier: int, bits: int) -> np.ndarray:
    """Signature bits of each term at a tier, HASHES a row; `bits` is a power of two."""
    h = hashes ^ _MIX[tier]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return ((h[:, None] + k * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """As few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))).newbyteorder("<")).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n if n else 1}").astype(np.int64)


INDEX = ("block string, n_docs long, n_terms long, ids binary, named binary, lengths binary, sizes binary, "
         "places binary, tfs binary, words binary, dfs binary, classes binary, slices binary")


def _row(name: str, ids: list, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A block: `found` has each document's term hashes and frequencies."""
    keys = np.array([sum(int((tf >= t).sum()) for t in TIERS) for _, tf in found])
    order = np.argsort(keys, kind="stable")
    ids, found, keys = [ids[d] for d in order], [found[d] for d in order], keys[order]
    sizes = np.array([len(h) for h, _ in found])
    hashes, tfs = (np.concatenate([f[side] for f in found]) for side in (0, 1))
    words, places, dfs = np.unique(hashes, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(ids)), sizes)
    inside = np.lexsort((places, doc))
    hashes, places, tfs = hashes[inside], places[inside], tfs[inside]
    lengths = np.bincount(doc, tfs, len(ids)).astype(np.int64)
    room = 1 << np.ceil(np.log2(np.maximum(keys, 1))).astype(np.int64)
    classes, slices, start = [], [], 0
    for most in np.unique(room):
        stop = start + int((room == most).sum())
        bits = int(most) * BITS
        mine = slice(*np.searchsorted(doc, [start, stop]))
        flags = np.zeros((bits, stop - start), bool)
        for tier, least in enumerate(TIERS):
            often = tfs[mine] >= least
            at = _places(hashes[mine][often], tier, bits)
            flags[at.ravel(), np.repeat(doc[mine][often] - start, HASHES)] = True
        classes.append((bits, stop - start))
        slices.append(np.packbits(flags, axis=1).tobytes())
        start = stop
    values = (name, int((lengths > 0).sum()), int(lengths.sum()),
              np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
              np.array([i is not None for i in ids], "<u1").tobytes(), lengths.astype("<i8").tobytes(),
              sizes.astype("<u4").tobytes(), places.astype("<u4").tobytes(), _packed(tfs),
              words.astype("<u8").tobytes(), dfs.astype("<u4").tobytes(), np.array(classes, "<u4").tobytes(),
              b"".join(slices))
    fields = [f.split() for f in INDEX.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields)],
                                      names=[n for n, _ in fields])


def _hashes(found: Counter) -> tuple[np.ndarray, np.ndarray]:
    n = len(found)
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n),
            np.fromiter(found.values(), np.int64, n))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, found, entries = [], [], 0
    for batch in batches:
        for piece in text_slices(batch):
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                ids.append(key)
                found.append(_hashes(terms(text)))
                entries += len(found[-1][0])
                if len(ids) == BLOCK or entries >= BLOCK_ENTRIES:
                    yield _row(f"{part}-{number}", ids, found)
                    number, ids, found, entries = number + 1, [], [], 0
    if ids:
        yield _row(f"{part}-{number}", ids, found)


def index(docs: DataFrame) -> DataFrame:
    """The written index of all documents, a row a block."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index, INDEX))


def _frequencies(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(wanted), np.int64)
    for batch in batches:
        for words, dfs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, dfs = np.frombuffer(words, "<u8"), np.frombuffer(dfs, "<u4")
            at = np.searchsorted(wanted, words)
            known = wanted[np.minimum(at, len(wanted) - 1)] == words
            total[at[known]] += dfs[known]
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["place", "df"])


class Block:
    def __init__(self, row: dict, n: int, total: int):
        self.ids, self.lengths = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["lengths"], "<i8")
        self.named = np.frombuffer(row["named"], "<u1") > 0
        self.ends = np.cumsum(np.frombuffer(row["sizes"], "<u4").astype(np.int64))
        self.places = np.frombuffer(row["places"], "<u4")
        self.tfs = _unpacked(row["tfs"], len(self.places))
        self.words = np.frombuffer(row["words"], "<u8")
        self.classes = np.frombuffer(row["classes"], "<u4").reshape(-1, 2).tolist()
        self.slices = np.frombuffer(row["slices"], np.uint8)
        self.m = 25 + 75 * self.lengths * n // max(total, 1)

    def present(self, asked: np.ndarray) -> Iterator[np.ndarray]:
        """For each tier a row a term: 1 where a document may hold it that often; never 0 where it does."""
        tiers = [[] for _ in TIERS]
        start = 0
        for bits, docs in self.classes:
            width = -(-docs // 8)
            own = self.slices[start:start + bits * width].reshape(bits, width)
            start += bits * width
            held = None
            for tier, out in enumerate(tiers):
                bitmap = np.bitwise_and.reduce(own[_places(asked, tier, bits)], axis=1)
                held = bitmap if held is None else held & bitmap
                out.append(np.unpackbits(held, axis=1, count=docs))
        return (np.concatenate(t, axis=1) for t in tiers)

    def bounds(self, asked: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bounds of the scores, a row an item. Sums stay below 2 ** 53, so they are exact."""
        out = np.zeros((len(items), len(self.ids)))
        before = 0
        for tier, held in enumerate(self.present(asked)):
            most = TIERS[tier + 1] - 1 if tier + 1 < len(TIERS) else 0
            share = share_of(most, self.m) if most else np.full(len(self.m), FULL)
            for row, (which, weights) in zip(out, items):
                row += (weights @ held[which].astype(float)) * (share - before)
            before = share
        out[:, ~self.named] = -1
        return out

    def score(self, doc: int, local: np.ndarray, weights: np.ndarray) -> int:
        """Exactly; `local` are the item's terms as numbers of this block."""
        lo, hi = self.ends[doc - 1] if doc else 0, self.ends[doc]
        mine = self.places[lo:hi]
        at = np.searchsorted(mine, local)
        at[at == len(mine)] = 0
        held = mine[at] == local
        return int((weights[held] * share_of(self.tfs[lo:hi][at[held]], self.m[doc])).sum())


def share_of(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _search(batches: Iterator[pa.RecordBatch], asked: np.ndarray, names: pa.Array,
            items: list[tuple[np.ndarray, np.ndarray]], n: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple[int, int]]] = [[] for _ in items]      # (-score, doc_id), sorted
    for batch in batches:
        for number in range(batch.num_rows):
            block = Block({c: batch.column(c)[number].as_py() for c in batch.schema.names}, n, total)
            if not len(block.words):
                continue
            local = np.searchsorted(block.words, asked)
            local[block.words[np.minimum(local, len(block.words) - 1)] != asked] = len(block.words)  # held by none
            for bound, top, (which, weights) in zip(block.bounds(asked, items), best, items):
                order = np.argsort(-bound, kind="stable")
                done = 0
                while done < len(order):
                    floor = -top[-1][0] if len(top) == k else 1
                    more = order[done:done + 2 * k]
                    more = more[bound[more] >= floor]
                    if not len(more):
                        break
                    scored = [(-block.score(d, local[which], weights), int(block.ids[d])) for d in more.tolist()]
                    top[:] = sorted([*top, *(s for s in scored if s[0] < 0)])[:k]
                    done += 2 * k
    out = [(q, d, -s) for q, top in enumerate(best) for s, d in top]
    yield pa.RecordBatch.from_arrays(
        [names.take(pa.array([q for q, _, _ in out], pa.int64())), pa.array([d for _, d, _ in out], pa.int64()),
         pa.array([s for _, _, s in out], pa.int64())], names=["item_id", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, 64):
            rows = [(n, *_hashes(sum(map(terms, texts), Counter()))) for n, texts in enumerate(piece.column(1).to_pylist())]
            sizes = [len(h) for _, h, _ in rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(owner)),
                 pa.array(np.concatenate([np.empty(0, np.uint64), *(h for _, h, _ in rows)]).view(np.int64)),
                 pa.array(np.concatenate([np.empty(0, np.int64), *(t for _, _, t in rows)]))],
                names=["item_id", "term", "n"])


def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, term, n of each item, written once."""
    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.where("text is not null").groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    return cut(texts.mapInArrow(_item_terms, f"item_id {kind}, term long, n long"))


def _chunk(asked: DataFrame, built: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """The best rows of each task for items whose terms fit on the driver."""
    rows = asked.orderBy("item_id").toArrow()
    names = rows["item_id"].combine_chunks()
    hashes = rows["term"].to_numpy().view(np.uint64)
    kind = f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id long, score long"
    if not len(hashes):
        return asked.sparkSession.createDataFrame([], kind)
    wanted, place = np.unique(hashes, return_inverse=True)
    dfs = np.zeros(len(wanted), np.int64)
    counts = built.select("words", "dfs").mapInArrow(partial(_frequencies, wanted=wanted), "place long, df long")
    for r in counts.groupBy("place").agg(F.sum("df").alias("df")).toArrow().to_batches():
        dfs[r["place"].to_numpy()] = r["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in dfs.tolist()])
    weights = rows["n"].to_numpy() * weight[place]
    # items in order of their rows, each with its terms that weigh anything
    codes = names.dictionary_encode(null_encoding="encode")
    useful = np.flatnonzero(weights > 0)
    code = codes.indices.to_numpy()[useful]
    cuts = np.flatnonzero(np.diff(code, prepend=-1))
    parts = np.split(useful, cuts[1:])
    asked_for = np.unique(place[useful])                    # their terms, renumbered
    items = [(np.searchsorted(asked_for, place[p]), weights[p]) for p in parts] if len(useful) else []
    found = codes.dictionary.take(pa.array(code[cuts])) if len(useful) else codes.dictionary.slice(0, 0)
    return built.drop("block", "n_docs", "n_terms", "dfs").mapInArrow(
        partial(_search, asked=wanted[asked_for], names=found, items=items, n=n, total=total, k=k), kind)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for every item."""
    built = index(docs)
    sums = built.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"),
                     F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    asked = asked_terms(items)
    chunks = max(1, math.ceil(asked.count() / CHUNK))
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(chunks))
    best = None
    for c in range(chunks):
        part = _chunk(asked.where(dealt == c), built, sums["n"], sums["total"], k)
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
