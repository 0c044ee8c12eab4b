"""Align the tokens of two tokenizers over the same text, and count which tokens go together.

A is a byte-level vocabulary, applied to a space and the text; B is a piece vocabulary, applied to the text (it adds that
space itself). Both cover the same bytes. Offsets where a token of A and one of B end together are
cuts; between two neighbouring cuts lies a group, and every A token of a group is linked to every B token of it.

Divide and conquer: a span of tokens is divided at a common end near its middle. The end of the middle A
token is sought among B's ends by bisection, then those beside it in rings of doubling width; the halves go
on alike, and a span without a common end inside is a group. All spans of a slice of documents are divided at
once, level by level, in numpy, so a level costs a few array passes.

Counting: an id pair's count is the number of documents of the whole table that hold it linked. Each task gathers its
documents in blocks of about BLOCK_BYTES of text: a block keeps its distinct pairs once, with the number of
its documents that hold each, and every document as places in that list. Only the lists are counted over all blocks and
joined with the counts, far fewer rows than documents' links; then each block meets its own list again. The
highest count of each A id is one row an id, at most the size of its vocabulary, which bounds the only broadcast.

Null and empty texts, and those whose tokens' bytes differ from space and text (for instance because B writes U+2581
for a space), have no tokens: zeros and an empty digest. Special tokens' strings inside a text are plain text. Repeated
rows are documents of their own; rows without id are aligned and counted like others. Texts are read whole. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import utf8
from tallybook.llm.packing import Encoder, vocabulary
from tallybook.session import cut

B_BITS = 15                    # a pair is one number: A id * 2 ** B_BITS + B id
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20          # documents aligned together, at least one
MANY = 1 << 16                 # groups with more links are counted by distinct ids
LIST_ROWS = 50_000             # pairs in a row of a block's list

DOCUMENT = ["n_a", "n_b", "n_groups", "n_links"]


def pieces_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Tokens:
    """Ids of both tokenizers, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        import base64

        import sentencepiece

        self.a = Encoder(path_a)
        self.a.whole.encode_special_tokens = True
        with open(f"{path_a}.tiktoken", "rb") as f:
            ranks = {int(n): base64.b64decode(b) for b, n in map(bytes.split, f)}
        self.bytes_a = [ranks.get(n, b"") for n in range(max(ranks) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.b.get_piece_size()
        if size > 1 << B_BITS or len(self.bytes_a) > 1 << (32 - B_BITS):
            raise ValueError("a vocabulary is too large for pairs of 32 bits")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else utf8(p.replace("▁", " "))
                        for n, p in enumerate(map(self.b.id_to_piece, range(size)))]
        # decimal ids with the separator behind them: within a side, after the A side, after the B side
        most = max(size, len(self.bytes_a))
        self.spelled = [f"{n}{mark}" for mark in ",|;" for n in range(most)]
        self.most = most

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and B for each text; none where they don't give back the text."""
        real = [t for t in texts if t]
        pieces = iter(self.b.encode(real, num_threads=1) if real else [])
        out = []
        for text in texts:
            a, b = (self.a(" " + text), next(pieces)) if text else ([], [])
            whole = utf8(" " + text) if text else b""
            if (b"".join(map(self.bytes_a.__getitem__, a)) != whole
                    or b"".join(map(self.bytes_b.__getitem__, b)) != whole):
                a, b = [], []
            out.append((a, b))
        return out


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of A tokens inside the spans first to last - 1 that end where a B token ends, in no order.

    Ends rise over all spans; a span's own last end is common already and not among the results.
    """
    cuts = []
    while len(first):
        inner = last - 1 - first                       # ends inside the span
        first, last = first[inner > 0], last[inner > 0]
        middle = (first + last - 2) // 2
        found = np.full(len(first), -1)
        seeking, near, far = np.arange(len(first)), 0, 0
        while len(seeking):
            f, m, stop = first[seeking], middle[seeking], last[seeking] - 1
            low, high = np.maximum(f, m - far), np.minimum(stop, m + far + 1)
            left = np.maximum(m - near + 1 - low, 0)
            right = np.maximum(high - (m + near), 0) if near else np.zeros_like(left)
            size = left + right
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            from_left = at < np.repeat(left, size)
            at += np.where(from_left, np.repeat(low, size), np.repeat(m + near - left, size))
            owner = np.repeat(seeking, size)
            place = np.searchsorted(ends_b, ends_a[at])
            hit = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a[at]
            at, owner = at[hit], owner[hit]
            if near:
                order = np.lexsort((np.abs(at - middle[owner]), owner))
                at, owner = at[order], owner[order]
                nearest = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
                at, owner = at[nearest], owner[nearest]
            found[owner] = at
            seeking = seeking[(found[seeking] < 0) & ((low > f) | (high < stop))]
            near, far = far + 1, 2 * far + 1
        divided = found >= 0
        cuts.append(found[divided])
        first, last = (np.concatenate([first[divided], cuts[-1] + 1]),
                       np.concatenate([cuts[-1] + 1, last[divided]]))
    return np.concatenate(cuts) if cuts else np.empty(0, int)


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _sizes(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0)


class Aligned:
    """A slice of documents: groups, and for every document its distinct pairs with their numbers of links."""

    def __init__(self, tokens: Tokens, length_a: np.ndarray, length_b: np.ndarray, texts: list[str | None]):
        ids = tokens.encode(texts)
        self.n_a = np.array([len(a) for a, _ in ids], np.int64)
        self.n_b = np.array([len(b) for _, b in ids], np.int64)
        a, b = (np.fromiter(chain.from_iterable(pair[side] for pair in ids), np.int64, int(n.sum()))
                for side, n in ((0, self.n_a), (1, self.n_b)))
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        last = np.cumsum(self.n_a)
        whole = np.flatnonzero(self.n_a)
        cuts = common_ends(ends_a, ends_b, (last - self.n_a)[whole], last[whole])
        stop_a = np.sort(np.concatenate([cuts, last[whole] - 1])) + 1      # of each group
        stop_b = np.searchsorted(ends_b, ends_a[stop_a - 1]) + 1
        size_a, size_b = _sizes(stop_a), _sizes(stop_b)
        doc = np.searchsorted(last, stop_a)                                # a group's document
        self.n_groups = np.bincount(doc, minlength=len(texts))
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, doc, size_a * size_b)
        self.n_links = links
        self._spell(tokens, a, b, size_a, size_b, stop_a, stop_b)
        self._link(a, b, size_a, size_b, stop_a - size_a, stop_b - size_b, doc, len(texts))

    def _spell(self, tokens, a, b, size_a, size_b, stop_a, stop_b):
        """SHA-256 of the groups, each its A ids, then its B ids."""
        group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        both = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[stop_a - 1], mark_b[stop_b - 1] = tokens.most, 2 * tokens.most
        both[np.arange(len(a)) + (stop_b - size_b)[group_a]] = a + mark_a
        both[np.arange(len(b)) + stop_a[group_b]] = b + mark_b
        parts = list(map(tokens.spelled.__getitem__, both.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.digests = [hashlib.sha256("".join(parts[lo:hi])[:-1].encode()).hexdigest() if hi > lo else ""
                        for lo, hi in zip([0, *ends], ends)]

    def _link(self, a, b, size_a, size_b, start_a, start_b, doc, n):
        many = size_a * size_b > MANY
        few = np.flatnonzero(~many)
        reach = np.repeat(size_b[few], size_a[few])                        # links of each A token
        at_a = np.repeat(_spread(size_a[few], start_a[few]), reach)
        at_b = _spread(reach, np.repeat(start_b[few], size_a[few]))
        keys = (np.repeat(np.repeat(doc[few], size_a[few]), reach) << 32) | a[at_a] << B_BITS | b[at_b]
        keys, times = np.unique(keys, return_counts=True)
        for g in np.flatnonzero(many):
            one, times_a = np.unique(a[start_a[g]:start_a[g] + size_a[g]], return_counts=True)
            two, times_b = np.unique(b[start_b[g]:start_b[g] + size_b[g]], return_counts=True)
            more = (doc[g] << 32 | one[:, None] << B_BITS | two).ravel()
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, np.outer(times_a, times_b).ravel()])).astype(np.int64)
        self.pairs, self.times = (keys & 0xFFFFFFFF).astype(np.uint32), times
        self.n_pairs = np.bincount(keys >> 32, minlength=n)


_SCHEMA = ("block string, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "places binary, times binary, pairs array<struct<at:int,pair:long,docs:int>>")
_PAIRS = pa.list_(pa.struct([("at", pa.int32()), ("pair", pa.int64()), ("docs", pa.int32())]))


def _block(name: str, key_type: pa.DataType, keys: list, parts: list[Aligned]) -> Iterator[pa.RecordBatch]:
    pairs, places = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    held = np.bincount(places, minlength=len(pairs))      # a document's pairs are distinct
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    ends = np.cumsum(np.concatenate([p.n_pairs for p in parts])).tolist()
    places, times = places.astype("<u4"), np.concatenate([p.times for p in parts])
    times = times.astype("<u1" if not len(times) or times.max() < 256 else "<u8")
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in DOCUMENT]
    spans = list(zip([0, *ends], ends))
    n = len(keys)
    yield pa.RecordBatch.from_arrays(
        [pa.array([name] * n, pa.string()), pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in columns),
         pa.array([d for p in parts for d in p.digests], pa.string()),
         pa.array([places[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
         pa.array([times[lo:hi].tobytes() for lo, hi in spans], pa.binary()), pa.nulls(n, _PAIRS)], names=names)
    for lo in range(0, len(pairs), LIST_ROWS):
        part = slice(lo, lo + LIST_ROWS)
        entries = pa.StructArray.from_arrays(
            [pa.array(np.arange(len(pairs), dtype=np.int32)[part]), pa.array(pairs[part].astype(np.int64)),
             pa.array(held[part].astype(np.int32))], names=["at", "pair", "docs"])
        row = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.string()), pa.nulls(1, key_type), *(pa.nulls(1, pa.int64()) for _ in DOCUMENT),
             pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), row], names=names)


def _align(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    tokens = Tokens(path_a, path_b)
    length_a, length_b = (np.array([len(x) for x in side], np.int64) for side in (tokens.bytes_a, tokens.bytes_b))
    part, number, kind = TaskContext.get().partitionId(), 0, None
    keys, parts, size = [], [], 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for ids, texts, n in _slices(batch):
            keys += ids
            parts.append(Aligned(tokens, length_a, length_b, texts))
            size += n
            if size >= BLOCK_BYTES:
                yield from _block(f"{part}-{number}", kind, keys, parts)
                number, keys, parts, size = number + 1, [], [], 0
    if keys:
        yield from _block(f"{part}-{number}", kind, keys, parts)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list, int]]:
    ids, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1)):
        text = text.as_py()
        ids.append(key.as_py()), texts.append(text)
        size += len(text or "") + 64
        if size >= SLICE_BYTES:
            yield ids, texts, size
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, size


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The written blocks: rows of documents, and rows of each block's list of pairs (`pairs` not null)."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(partial(_align, path_a=path_a or vocabulary(), path_b=path_b or pieces_file()),
                               _SCHEMA.format(kind)))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n: documents that hold it linked, best: no pair of the same A id has a higher count."""
    counts = (blocks.where("pairs is not null").selectExpr("inline(pairs)")
              .groupBy("pair").agg(F.sum("docs").alias("n")))
    a = F.shiftright("pair", B_BITS)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))   # a row an id of the vocabulary
    return (counts.withColumn("a", a).join(F.broadcast(highest), "a")
            .select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))



def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _answer(rows: pa.Table, counted: pa.Table) -> pa.Table:
    """A block's documents with the counts of its list."""
    n, best = np.zeros((2, counted.num_rows), np.int64)
    at = counted["at"].to_numpy()
    n[at], best[at] = counted["n"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
    places = [np.frombuffer(p, "<u4") for p in rows["places"].to_pylist()]
    sizes = np.array([len(p) for p in places], np.int64)
    times = [np.frombuffer(t, "<u1" if len(t) == len(p) else "<u8").astype(np.int64)
             for t, p in zip(rows["times"].to_pylist(), places)]
    places, times = np.concatenate([np.empty(0, "<u4"), *places]), np.concatenate([np.empty(0, np.int64), *times])
    return pa.table({
        "doc_id": rows["doc_id"], **{c: rows[c] for c in DOCUMENT},
        "n_best": pa.array(_sums(best[places] * times, sizes)),
        "count_sum": pa.array(_sums(n[places] * times, sizes)), "groups_sha256": rows["groups_sha256"]})


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    blocks = aligned(docs, path_a, path_b)
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = blocks.where("pairs is not null").selectExpr("block", "inline(pairs)").select("block", "at", "pair")
    counted = listed.join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "at", "n", "best")
    rows = blocks.where("pairs is null").drop("pairs")
    return (rows.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(
        _answer, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string"))
