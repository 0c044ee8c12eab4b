"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three characters, words padded by a
blank) of a language, most frequent first. A text is compared with each profile by the out-of-place
distance: the summed rank differences of the text's own most frequent n-grams, an absent one counting as
the profile's length.

Nulls, empty texts and texts without a letter are `und` with score 0. Rows without a language teach
nothing; with no usable training row every text is `und`. Equal frequencies are ranked by the n-gram's
code, equal distances by the language's name. Repeated rows count as often as they occur. Texts of any
length are read whole, in windows, so memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices

PROFILE = 400        # n-grams of a language profile
TEXT_PROFILE = 300   # most frequent n-grams of a text that are compared
MAX_LANGUAGES = 500  # profiles are handed to every task; more languages than this are refused
WINDOW = 1 << 18     # characters that are counted at once
UND = "und"

_LETTER = np.zeros(0x10000, dtype=bool)  # of the basic plane
_LETTER[[c for c in range(0x10000) if chr(c).isalpha()]] = True
SPACE = 32


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers, every run of anything else as one blank, blanks at both ends."""
    raw = text.lower().encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(raw, dtype=np.uint32)
    letter = _LETTER[np.minimum(chars, 0xFFFF)]
    beyond = np.flatnonzero(chars > 0xFFFF)
    if len(beyond):  # such letters share 4,096 codes of the private-use area
        letter[beyond] = [chr(c).isalpha() for c in chars[beyond]]
        chars = np.where(chars > 0xFFFF, 0xE000 + (chars & 0xFFF), chars)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for the run
    out = np.where(letter, chars, SPACE)[keep]
    return np.concatenate(([SPACE], out, [SPACE] if not len(out) or out[-1] != SPACE else []))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of a whole text; an n-gram's code packs 16 bits a character.

    A word that crosses a window's edge counts as two words.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, max(len(text), 1), WINDOW):
        c = _codes(text[start:start + WINDOW]).astype(np.int64)
        if len(c) < 3:
            continue
        one = c[c != SPACE]
        two = (c[:-1] << 16 | c[1:])
        three = (c[:-2] << 32 | c[1:-1] << 16 | c[2:])
        three = three[c[1:-1] != SPACE]  # an n-gram never spans two words
        parts.append(np.unique(np.concatenate((one, two, three)), return_counts=True))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for piece in text_slices(batch):
            own: dict[str, list] = {}
            for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                own.setdefault(lang, []).append(ngram_counts(text))
            for lang, parts in own.items():
                sums[lang] = merged(([sums[lang]] if lang in sums else []) + parts)
        for lang, (grams, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                names=["lang", "gram", "n"])


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang",
             size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of all rows with text and language; counts cover every row and whole text."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counted = rows.mapInArrow(_count_batches, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
            .select("lang", "gram", "rank"))


def model_of(profile_rows: DataFrame) -> dict[str, np.ndarray]:
    """The profiles on the driver: at most MAX_LANGUAGES times the profile's length."""
    langs = profile_rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if langs > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, list] = {}
    for r in profile_rows.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in sorted(out.items())}


class Ranks:
    """Profiles as one sorted table: n-gram -> its rank in each language (absent: the profile's length)."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.langs = sorted(model)
        self.absent = max((len(v) for v in model.values()), default=0)
        self.grams = np.unique(np.concatenate([*model.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), self.absent, np.int64)
        for j, name in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, model[name]), j] = np.arange(len(model[name]))

    def best(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UND, 0.0
        grams, n = ngram_counts(text)
        if not len(grams):
            return UND, 0.0
        order = np.lexsort((grams, -n))[:TEXT_PROFILE]
        own = grams[order]
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        at[~known] = len(self.grams)  # the row of absent n-grams
        ranks = self.rank[at]
        place = np.abs(ranks - np.arange(len(own))[:, None])
        place[ranks == self.absent] = self.absent
        distance = place.sum(0)
        j = int(np.argmin(distance))
        # closeness: 1 when every n-gram stands at its place, 0 when none is in the profile
        return self.langs[j], float(max(0.0, 1.0 - distance[j] / (self.absent * len(own))))


def _predict(batches: Iterator[pa.RecordBatch], model: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    ranks = Ranks(model)
    for batch in batches:
        for piece in text_slices(batch):
            found = [ranks.best(t) for t in piece.column(piece.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                names=[*piece.schema.names[:-1], "lang_pred", "score"])


def identify(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None,
             text: str = "text") -> DataFrame:
    """The columns named in `keep`, then lang_pred and score, for every row; nothing else is read."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*fields, "lang_pred string", "score double"])
    return rows.mapInArrow(partial(_predict, model=model), schema)
