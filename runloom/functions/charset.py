"""Text of bytes whose encoding isn't told: byte order marks, UTF state, and how often byte pairs are common ones."""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What takes the place of bytes that are no text; marks; and for encodings of two bytes a character their common first bytes, second bytes, and the share of pairs that must be such.
PLACEHOLDER = "[BINARY DATA FILE]"
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_PAIRS = (
    ("euc_jp", (0xA4, 0xA5), ((0xA1, 0xFE),), 0.3),
    ("shift_jis", (0x82, 0x83), ((0x40, 0x7E), (0x80, 0xF1)), 0.3),
    ("euc_kr", (0xB0, 0xC8), ((0xA1, 0xFE),), 0.95),
    ("gbk", (0xB0, 0xD7), ((0xA1, 0xFE),), 0.7),
    ("big5", (0xA4, 0xC6), ((0x40, 0x7E), (0xA1, 0xFE)), 0.85),
)
#: Punctuation of the East Asian sets, which tells none from another.
_SIGNS = (0xA1, 0xA3)
_CONTROL = re.compile(r"[\x00-\x08\x0E-\x1A\x1C-\x1F]")


def _pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """First and second bytes of pairs, taken from the left: a byte from 0x81 on and what follows it; and whether they look like words: at least half of them touch another, and two differ."""
    b = np.frombuffer(raw, dtype=np.uint8)
    high = b >= 0x81
    at = np.flatnonzero(high)
    if not len(at):
        return b[:0], b[:0], False
    # within a run of high bytes every other one is a first byte; a low byte after an odd run is a second
    new = np.r_[True, np.diff(at) > 1]
    runs = np.maximum.accumulate(np.where(new, at, 0))
    first = at[(at - runs) % 2 == 0]
    first = first[first + 1 < len(b)]
    touch = np.diff(first) == 2
    joined = np.r_[touch, False] | np.r_[False, touch]
    a, z = b[first], b[first + 1]
    words = len(first) > 1 and joined.mean() >= 0.5 and bool(((a != a[0]) | (z != z[0])).any())
    return a, z, words


def _decodes(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except (UnicodeDecodeError, LookupError):
        return None


def guessed(raw: bytes | None) -> tuple[str | None, str | None]:
    """A text and its encoding; the placeholder and no encoding for what is no text.

    A byte order mark decides, then valid UTF-8. Zeros at nearly every even or odd place are
    UTF-16. Other control bytes, if there are more than a few, are no text. Else the encoding
    of two bytes counts whose characters the bytes can be and whose common pairs are frequent
    enough and stand together, as two western letters may be a pair by chance; and else Windows' western one, or ISO 8859-1 where that has no character.
    """
    if raw is None:
        return None, None
    for mark, name in _MARKS:
        if raw.startswith(mark) and (text := _decodes(raw, name)) is not None:
            return text, name
    b = np.frombuffer(raw, dtype=np.uint8)
    control = (b < 0x20) & ~np.isin(b, [9, 10, 12, 13, 27])
    if (text := _decodes(raw, "utf-8")) is not None and not (b == 0).any():
        return text, "utf-8"
    if len(b) % 2 == 0 and (b == 0).any():
        for name, zero in (("utf-16-le", b[1::2]), ("utf-16-be", b[::2])):
            if (zero == 0).mean() > 0.7 and (text := _decodes(raw, name)) is not None and not _CONTROL.search(text):
                return text, name
    if (b == 0).any() or control.mean() > 0.02:
        return PLACEHOLDER, None
    first, second, words = _pairs(raw)
    signs = (first >= _SIGNS[0]) & (first <= _SIGNS[1]) & (second >= 0xA1)
    n = int((~signs).sum())
    for name, (low, high), seconds, share in _PAIRS:
        common = (first >= low) & (first <= high) & np.any([(second >= a) & (second <= z) for a, z in seconds], axis=0)
        if words and n and (common & ~signs).sum() >= share * n and (text := _decodes(raw, name)) is not None:
            return text, name
    if (text := _decodes(raw, "cp1252")) is not None:
        return text, "cp1252"
    return raw.decode("latin-1"), "latin-1"


@cache
def _udf():
    @F.pandas_udf("text string, encoding string")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([guessed(x) for x in raw], columns=["text", "encoding"])

    return run


def read_text(raw: Column) -> Column:
    """struct<text, encoding> of bytes. Bytes that are UTF-8 without zeros are read in place; only others are guessed."""
    plain = F.when(~F.contains(raw, F.lit(b"\x00")) & ~F.startswith(raw, F.lit(codecs.BOM_UTF8)), F.try_validate_utf8(raw.cast("string")))
    own = F.struct(plain.alias("text"), F.lit("utf-8").alias("encoding"))
    return F.when(plain.isNotNull(), own).otherwise(_udf()(F.when(plain.isNull(), raw)))
