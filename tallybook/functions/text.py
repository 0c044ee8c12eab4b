"""Text, number, date and id cleaning as column expressions (all evaluated in the JVM)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.registry import (
    DEFAULT_STATUS, MISSING_CELLS, STATUS_WORDS, TRANSLITERATION,
)

ARABIC = "[؀-ۿ]"
# White space as text tools outside the JVM understand it: every Unicode blank and the separators.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
CURRENCY = "£$€¥₹₽¢﷼"
INFINITY = float("inf")


def _composed_letters() -> str:
    """Pattern of `letter + combining mark` pairs that have a one-character composed form."""
    marks = {}
    for code in range(0x300, 0x370):
        letters = "".join(
            chr(c) for c in range(ord("a"), ord("z") + 1)
            if len(unicodedata.normalize("NFC", chr(c) + chr(code))) == 1
        )
        if letters:
            marks[code] = letters
    return "|".join(f"[{letters}]\\x{{{code:x}}}" for code, letters in marks.items())


def _composed_arabic() -> dict[str, str]:
    """Arabic base + mark pairs and their composed letter, taken from the Unicode tables."""
    pairs = {}
    for code in range(0x600, 0x700):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.normalize("NFC", parts) == chr(code):
            pairs[parts] = chr(code)
    return pairs


COMPOSED_LATIN = _composed_letters()
COMPOSED_ARABIC = _composed_arabic()
COMBINING = r"[\x{300}-\x{36f}\x{653}-\x{655}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalise_header(c: Column) -> Column:
    """Lower-case header with every run of other characters than a-z, 0-9, Arabic as one `_`."""
    lower = F.lower(c)
    composed = lower
    for parts, whole in COMPOSED_ARABIC.items():
        composed = F.replace(composed, F.lit(parts), F.lit(whole))
    composed = F.regexp_replace(composed, COMPOSED_LATIN, "_")
    out = F.when(lower.rlike(COMBINING), composed).otherwise(lower)
    out = F.regexp_replace(out, "[^a-z0-9؀-ۿ]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def transliterate(c: Column) -> Column:
    """Arabic letters to Latin ones; two-letter results first, the rest in one `translate`."""
    out = c
    for letter, latin in TRANSLITERATION.items():
        if len(latin) == 2:
            out = F.replace(out, F.lit(letter), F.lit(latin))
    single = [(k, v) for k, v in TRANSLITERATION.items() if len(v) == 1]
    gone = [k for k, v in TRANSLITERATION.items() if not v]
    return F.translate(
        out, "".join(k for k, _ in single) + "".join(gone), "".join(v for _, v in single)
    )


NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """Plain decimal or exponent notation to double, anything else (also `5d`, `inf`) to null."""
    return F.regexp_extract(strip(c), NUMBER, 0).try_cast("double")


def amount(c: Column) -> Column:
    """Number as people type it: Arabic-Indic digits, currency marks, blanks, thousands commas."""
    t = F.translate(c, "٠١٢٣٤٥٦٧٨٩" + CURRENCY + "," + SPACES, "0123456789")
    return F.regexp_extract(F.regexp_replace(t, "(?i)egp", ""), NUMBER, 0).try_cast("double")


def finite(value: Column) -> Column:
    """Null for a number too large for a double. Apply to a column, not to a long expression."""
    return F.when(F.abs(value) < INFINITY, value)


def not_token(value: Column, *tokens: str) -> Column:
    """Null for empty text and the given marks. Apply to a column, not to a long expression."""
    return F.when(~value.isin("", *tokens), value)


def clean_text(c: Column) -> Column:
    return not_token(strip(c), "nan", "None")


def id_text(c: Column) -> Column:
    """Without one trailing `.0` left by a float column, then trimmed."""
    return strip(F.when(c.endswith(".0"), F.substring(c, F.lit(1), F.length(c) - 2)).otherwise(c))


ID_TOKENS = ("nan", "None", "NaT")


def clean_status(c: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in STATUS_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(strip(c))), F.lit(DEFAULT_STATUS))


def stored_text(c: Column) -> Column:
    """Text as the store keeps it: trimmed, `nan` / `none` in any case are null."""
    t = strip(c)
    return F.when(~F.lower(t).isin("", "nan", "none"), t)


def missing_cell(c: Column) -> Column:
    return F.when(~c.isin(*MISSING_CELLS), c)


# Date notations tried per dataset column: cheap shape test, pattern. Month-first precedes day-first,
# so it wins when both read every value equally well.
# The shapes admit only real months, days and clock times, so that hardly any parse has to fail.
CLOCK = "[ H:mm[:ss]]"
_Y, _M, _D = r"\d{4}", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_HM = r"(?:[01]?\d|2[0-3]):[0-5]\d"
_TIME = rf"(?: {_HM}(?::[0-5]\d)?)?$"
_FINE = rf"{_HM}(?::[0-5]\d(?:\.\d{{1,6}})?)?"
DATE_FORMATS: list[tuple[str, str]] = [
    (rf"^{_Y}-{_M}-{_D}(?: {_FINE})?$", "yyyy-M-d[ H:mm[:ss[.SSSSSS]]]"),
    (rf"^{_Y}-{_M}-{_D}T{_FINE}$", "yyyy-M-d'T'H:mm[:ss[.SSSSSS]]"),
    (rf"^{_Y}/{_M}/{_D}{_TIME}", "yyyy/M/d" + CLOCK),
    (rf"^{_M}/{_D}/{_Y}{_TIME}", "M/d/yyyy" + CLOCK),
    (rf"^{_D}/{_M}/{_Y}{_TIME}", "d/M/yyyy" + CLOCK),
    (rf"^{_M}-{_D}-{_Y}{_TIME}", "M-d-yyyy" + CLOCK),
    (rf"^{_D}-{_M}-{_Y}{_TIME}", "d-M-yyyy" + CLOCK),
    (rf"^{_M}/{_D}/\d\d{_TIME}", "M/d/yy" + CLOCK),
    (rf"^{_D}/{_M}/\d\d{_TIME}", "d/M/yy" + CLOCK),
    (rf"^{_D}\.{_M}\.{_Y}{_TIME}", "d.M.yyyy" + CLOCK),
    (rf"^{_D} [A-Z][a-z]{{2}} {_Y}{_TIME}", "d MMM yyyy" + CLOCK),
    (rf"^{_D} [A-Z][a-z]{{3,8}} {_Y}{_TIME}", "d MMMM yyyy" + CLOCK),
    (rf"^[A-Z][a-z]{{2}} {_D}, {_Y}{_TIME}", "MMM d, yyyy" + CLOCK),
    (rf"^[A-Z][a-z]{{3,8}} {_D}, {_Y}{_TIME}", "MMMM d, yyyy" + CLOCK),
    (rf"^{_Y}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])$", "yyyyMMdd"),
]


def read_date(c: Column, number: int) -> Column:
    """Trimmed text read by one notation, null where it does not fit; wall-clock time, no zone."""
    shape, pattern = DATE_FORMATS[number]
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(pattern))).cast("timestamp_ntz")


# How each of the shapes begins.
DATE_START = r"^(?:\d{1,4}[-/. ]|[A-Z][a-z]{2,8} \d|\d{8}$)"


def is_date(c: Column) -> Column:
    """Whether any notation reads the trimmed text; most texts fail at how they begin."""
    read = F.coalesce(*[read_date(c, i) for i in range(len(DATE_FORMATS))])
    return F.when(c.rlike(DATE_START), read.isNotNull()).otherwise(F.lit(False))


def iso_seconds(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def letter_masks(word: str) -> dict[str, int]:
    """Bit i of a letter's mask is set where the word has that letter at place i."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(word):
        masks[letter] = masks.get(letter, 0) | 1 << i
    return masks


def letter_set(word: str) -> int:
    """Bit `code % 63` is set for each letter of the word; letters may share a bit."""
    bits = 0
    for letter in word:
        bits |= 1 << ord(letter) % 63
    return bits


def letter_set_of(text: Column) -> Column:
    """`letter_set` of a text column."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.array_distinct(F.split(text, "")), F.lit(0).cast("long"),
        lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", one, F.ascii(c) % 63)))


def common_letters(text: Column, masks: Column, size: Column) -> Column:
    """Length of the longest common subsequence of `text` and a word of at most 60 letters.

    The word is given as its letter masks, so each letter of the text costs a few integer operations
    on one row of the table, held as bits: a zero bit is a step of the subsequence.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1

    def step(row: Column, letter: Column) -> Column:
        hit = row.bitwiseAND(F.coalesce(F.try_element_at(masks, letter), F.lit(0).cast("long")))
        return (row + hit).bitwiseOR(row - hit).bitwiseAND(full)

    return size - F.bit_count(F.aggregate(F.split(text, ""), full, step))


def indel_ratio(text: Column, masks: Column, size: Column) -> Column:
    """Similarity 200 * LCS / (sum of lengths), between 0 and 100."""
    return common_letters(text, masks, size) * F.lit(200.0) / (F.length(text) + size)
