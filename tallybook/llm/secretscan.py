"""Find secrets: key words and key shapes, and runs of characters that pass for random.

Base spans come from three patterns (assignments to a secret's name, access keys, long hexadecimal). The
randomness battery adds spans of its own, of kind `random`; base spans stay.

Battery: every run of at least LEAST letters, digits and `+/_-` is a candidate. Its encoding is the smallest alphabet
that holds it (hexadecimal, base 32, 36, 62, 64, 64 for URLs, or letters alone); numbers are none, as card
and phone numbers are as random as keys. Two groups of three tests look at each:

* does it reject randomness? chi-squared uniformity of its alphabet (symbols in groups of like commonness, as
  many as the length can fill), runs above and below the middle of the alphabet, serial correlation of neighbouring
  symbols. A run that random symbols would beat with probability below REJECT (Fisher's combination) is none.
* could ordinary text be so? Common letters are fewer than text has (uniformity), letters, capitals and digits take
  turns more often (runs), vowels and consonants less often (serial dependence). Each is a binomial tail,
  bounded from above by its length and divergence (Chernoff), so p is never too small; Fisher combines them.

False discoveries: among all runs of the table whose length lies between two powers of two, Benjamini and Hochberg's
step-up rule finds the largest p at which at most FALSE_SHARE of the finds are expected to be text. Lengths
have rules of their own, so the many short words don't decide about long runs. Spark counts rounded p-values (at
most MOST_BIN a length class), so nothing grows with the table but the counts.

Null and empty texts have no spans (the digest is that of the empty text). Texts are scanned whole, however long.
Repeated rows, also of one id, give a row each and take part in the counts each. Rows without id are scanned like
others. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import erfc as _erfc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices
from tallybook.session import cut

KINDS = ("assign", "access", "hex", "random")
LEAST = 16
REJECT = 1e-4
FALSE_SHARE = 0.01
MOST_BIN = 30_000   # p-values are rounded up to hundredths of a power of ten
SLICE = 512

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
# one of these is in the lower-cased text wherever ASSIGN can match
NAMES = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
RUN = re.compile(f"[A-Za-z0-9+/_-]{{{LEAST},}}")

# fixed values: letters from the most to the least common in text
COMMON = "etaoinshrdlucmfwypvbgkjqxz"
DIGITS = "0123456789"
VOWELS = "aeiouyAEIOUY"
UPPER = COMMON.upper()
MIXED = "".join(a + b for a, b in zip(COMMON, UPPER))
# alphabets, common symbols first; the first that holds a run is its encoding
ALPHABETS = [
    DIGITS, COMMON, UPPER, "eadcfb" + DIGITS, "EADCFB" + DIGITS, UPPER + "234567", COMMON + DIGITS, UPPER + DIGITS,
    MIXED, MIXED + DIGITS, MIXED + DIGITS + "+/", MIXED + DIGITS + "_-", MIXED + DIGITS + "+/_-",
]
# shares in text of the common half of an alphabet's letters, of a change of kind between neighbours, and of two
# neighbours that are both vowels or both consonants; each is on the safe side of what prose and names show
TEXT_COMMON = 0.75
TEXT_CHANGE = 0.2
TEXT_ALIKE = 0.5

_RANK = np.full((len(ALPHABETS), 128), -1, np.int16)
_RARE = np.zeros((len(ALPHABETS), 128), bool)
for _rank, _rare, _symbols in zip(_RANK, _RARE, ALPHABETS):
    _rank[[ord(c) for c in _symbols]] = np.arange(len(_symbols))
    _letters = [ord(c) for c in _symbols if c.isalpha()]
    _rare[_letters[len(_letters) // 2:]] = True
_SIZE = np.array([len(a) for a in ALPHABETS])
_MISSING = ((_RANK < 0) * (1 << np.arange(len(ALPHABETS)))[:, None]).sum(0)   # bit a: not in alphabet a
_KIND = np.zeros(128, np.int8)
for _n, _symbols in enumerate((COMMON, UPPER, DIGITS), 1):
    _KIND[[ord(c) for c in _symbols]] = _n
_VOWEL = np.zeros(128, bool)
_VOWEL[[ord(c) for c in VOWELS]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    low = text.lower()
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6] if any(
        n in low for n in NAMES) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _two_sided(z: np.ndarray) -> np.ndarray:
    """Log of the probability of a normal deviate at least as far from 0; finite for any z."""
    z = np.minimum(np.abs(z), 35.0)
    return np.log(np.frompyfunc(_erfc, 1, 1)(z / np.sqrt(2)).astype(float))


def _fisher(*logs: np.ndarray) -> np.ndarray:
    """Log of Fisher's combination of three p-values given by their logs."""
    h = -sum(logs)
    return -h + np.log1p(h + h * h / 2)


def _tail(n: np.ndarray, found: np.ndarray, share: float) -> np.ndarray:
    """Log of a bound on the probability of at least `found` of n, each with probability `share`."""
    part = found / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = (part * np.log(part / share)
               + np.where(part < 1, (1 - part) * np.log((1 - part) / (1 - share)), 0))
    return np.where(part > share, -n * log, 0.0)


def battery(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: encoding (place in ALPHABETS), log p as random symbols, log p as text."""
    sizes = np.array([len(r) for r in runs], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer(b"".join(runs), np.uint8)
    owner = np.repeat(np.arange(len(runs)), sizes)
    missing = np.bitwise_or.reduceat(_MISSING[codes], starts)
    encoding = np.zeros(len(runs), np.int64)
    for a in reversed(range(len(ALPHABETS))):
        encoding[missing >> a & 1 == 0] = a
    symbols = _SIZE[encoding]
    rank = _RANK[encoding[owner], codes].astype(np.int64)
    inner = owner[1:] == owner[:-1]

    def per_run(values, where=None):
        return np.bincount(owner if where is None else where, values, len(runs))

    # uniformity: groups of neighbouring ranks, of about five expected symbols each
    groups = np.clip(sizes // 5, 2, symbols)
    first = np.cumsum(groups) - groups
    seen = np.bincount(first[owner] + rank * groups[owner] // symbols[owner], minlength=int(groups.sum()))
    of, wide = np.repeat(np.arange(len(runs)), groups), np.repeat(groups, groups)
    k = np.arange(len(of)) - first[of]
    ranks = -(-(k + 1) * symbols[of] // wide) + (-k * symbols[of] // wide)
    expected = sizes[of] * ranks / symbols[of]
    chi = np.add.reduceat((seen - expected) ** 2 / expected, first)
    free = groups - 1
    z = (np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))  # Wilson and Hilferty
    uniform = np.where(z > 0, _two_sided(z) - np.log(2), np.log1p(-np.exp(_two_sided(z)) / 2))

    # runs above and below the middle
    high = 2 * rank >= symbols[owner]
    above = per_run(high)
    mean = 2 * above * (sizes - above) / sizes
    turns = per_run((high[1:] != high[:-1]) & inner, owner[1:])
    spread = np.sqrt(np.maximum(mean * (mean - 1) / (sizes - 1), 1e-9))
    alternation = _two_sided((turns - mean) / spread)

    # serial correlation
    centred = rank - (per_run(rank) / sizes)[owner]
    power = np.maximum(per_run(centred ** 2), 1e-9)
    lag = per_run(centred[1:] * centred[:-1] * inner, owner[1:])
    constant = per_run(np.abs(centred)) < 1e-9
    serial = _two_sided(np.where(constant, 35.0, (lag / power + 1 / sizes) * np.sqrt(sizes)))

    # as text: symbols aside, as paths and names join words by them
    kind = _KIND[codes]
    kept = kind > 0
    who, kind, code = owner[kept], kind[kept], codes[kept]
    letter, same = kind < 3, who[1:] == who[:-1]
    rare = per_run(_RARE[encoding[who], code], who)
    changes = per_run((kind[1:] != kind[:-1]) & same, who[1:])
    both = letter[1:] & letter[:-1] & same
    alike = per_run(both & (_VOWEL[code[1:]] == _VOWEL[code[:-1]]), who[1:])
    text = _fisher(_tail(per_run(letter, who), rare, 1 - TEXT_COMMON),
                   _tail(per_run(same, who[1:]), changes, TEXT_CHANGE),
                   _tail(per_run(both, who[1:]), alike, TEXT_ALIKE))
    return encoding, _fisher(uniform, alternation, serial), text


def bins(runs: list[bytes]) -> list[int]:
    """-100 log10 of each run's p as text, rounded down; 0 where it isn't random either; -1 for numbers."""
    if not runs:
        return []
    encoding, random, text = battery(runs)
    out = np.where(random < np.log(REJECT), 0, np.minimum(-100 * text / np.log(10), MOST_BIN)).astype(int)
    return np.where(encoding == 0, -1, out).tolist()


_SPAN = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("end", pa.int32())])
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("size", pa.int32()), ("bin", pa.int32()),
                  ("fresh", pa.bool_())])


def _inside(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(a <= start and end <= b for a, _, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch, SLICE):
            rows, candidates, runs = [], [], []
            for n, text in enumerate(piece.column(1).to_pylist()):
                text = text or ""
                found = base_spans(text)
                counts = [sum(p == k for _, p, _ in found) for k in range(3)]
                digest = hashlib.sha256(spelled(found).encode()).hexdigest()
                rows.append((*counts, digest, [{"start": a, "place": p, "end": b} for a, p, b in found]))
                for m in RUN.finditer(text):
                    candidates.append((n, m.start(), m.end(), not _inside(m.start(), m.end(), found)))
                    runs.append(m.group().encode())
            mine = [[] for _ in rows]
            for (n, a, b, fresh), bin_ in zip(candidates, bins(runs)):
                if bin_ >= 0:
                    mine[n].append({"start": a, "end": b, "size": (b - a).bit_length(), "bin": bin_, "fresh": fresh})
            n_assign, n_access, n_hex, digest, base = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(c, pa.int64()) for c in (n_assign, n_access, n_hex)),
                 pa.array(digest, pa.string()), pa.array(base, pa.list_(_SPAN)), pa.array(mine, pa.list_(_RUN))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"])


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[p]}:{a}:{b}" for a, p, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """Base spans and judged runs of each document, written once."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(
        _scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "base array<struct<start:int,place:int,end:int>>, "
        "runs array<struct<start:int,end:int,size:int,bin:int,fresh:boolean>>"))


def cutoffs(judged: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """The least bin that counts as a find, by length class; classes without finds are absent."""
    counts = (judged.select(F.explode("runs").alias("r")).groupBy("r.size", "r.bin")
              .agg(F.count(F.lit(1)).alias("n")))
    # at most 31 classes of at most MOST_BIN + 1 bins
    down = Window.partitionBy("size").orderBy(F.desc("bin"))
    steps = counts.select("size", "bin", F.sum("n").over(down).alias("found"),
                          F.sum("n").over(Window.partitionBy("size")).alias("all"))
    passed = steps.where(F.pow(F.lit(10.0), -F.col("bin") / 100) * F.col("all") <= share * F.col("found"))
    return {r["size"]: r["bin"] for r in passed.groupBy("size").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document.

    `share` bounds the expected share of text among the runs found to be random.
    """
    judged = found(docs)
    least = cutoffs(judged, share)
    limit = lambda r: F.element_at(
        F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), r["size"])
    kept = (F.filter("runs", lambda r: r["fresh"] & (r["bin"] >= limit(r))) if least
            else F.filter("runs", lambda r: F.lit(False)))
    added = F.transform(kept, lambda r: F.struct(
        r["start"].alias("start"), F.lit(3).alias("place"), r["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    words = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.concat_ws(
        ":", F.element_at(names, s["place"] + 1), s["start"], s["end"]))
    return judged.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
                         F.concat_ws(",", words).alias("spans"), F.size(kept).cast("long").alias("n_random"))
