"""Other scripts to ASCII, approximately.

Indic scripts, whose letters are named by their sound (DEVANAGARI LETTER KA), follow their rule of the inherent vowel; the
letters of other scripts sound as the transliteration rules that come with Spark's JVM say, letter by letter. Text in
Latin script needs ``normalize.fold_latin``'s own expressions only, which stay in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"(?P<script>[A-Z]+) (?:CAPITAL |SMALL )?(?P<kind>LETTER|VOWEL SIGN|DIGIT) (?P<sound>[A-Z]+)")
_LATIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "þ": "th", "ð": "d", "ı": "i", "ħ": "h", "ŧ": "t"}
_INDIC = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"}
# Names of Greek letters by their sound.
_GREEK = {"ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "FINAL": "s", "TAU": "t", "UPSILON": "u", "PHI": "ph", "CHI": "ch", "PSI": "ps", "OMEGA": "o"}


@lru_cache(maxsize=1 << 16)
def sound(c: str) -> str:
    if c < "\x80":
        return c
    if (plain := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) != "":
        return plain
    if c.lower() in _LATIN:
        return _LATIN[c.lower()]
    m = _NAME.match(unicodedata.name(c, ""))
    if not m:
        return ""
    if m["kind"] == "DIGIT":
        return str(unicodedata.digit(c, ""))
    return _GREEK.get(m["sound"], m["sound"].lower()) if m["script"] == "GREEK" else m["sound"].lower()


#: Letters that the table of sounds covers: Greek to Tifinagh without Indic scripts, kana, Han and Hangul.
COVERED = [range(0x370, 0x900), range(0xE00, 0x1E00), range(0x1F00, 0x2000), range(0x2C00, 0x2E00), range(0x3040, 0x3130), range(0x4E00, 0xA000), range(0xAC00, 0xD7A4)]


@lru_cache(maxsize=1)
def sounds() -> tuple[str, str]:
    """The covered letters and, line by line, their ASCII sounds, as the session's JVM transliterates each by itself."""
    letters = "".join(chr(c) for part in COVERED for c in part if unicodedata.category(chr(c))[0] in "LN")
    jvm = SparkSession.active()._jvm
    rules = jvm.com.ibm.icu.text.Transliterator.getInstance("Any-Latin; Latin-ASCII; Lower")
    lines = rules.transliterate("\n".join(letters)).split("\n")
    return letters, "\n".join(re.sub("[^a-z0-9]", "", x) for x in lines)


@lru_cache(maxsize=2)
def _table(letters: str, lines: str) -> dict[str, str]:
    return dict(zip(letters, lines.split("\n"), strict=True))


def transliterate(text: str | None, table: dict[str, str] | None = None) -> str:
    """ASCII sounds of a text. An Indic consonant keeps its inherent a unless a vowel sign or a virama follows."""
    out = []
    for c in unicodedata.normalize("NFC", text or ""):
        if table and (known := table.get(c)):
            out.append(known)
            continue
        name = unicodedata.name(c, "") if c > "\x7f" else ""
        script = name.split(" ")[0]
        if script in _INDIC:
            if ("VOWEL SIGN" in name or "VIRAMA" in name) and out and out[-1].endswith("a") and len(out[-1]) > 1:
                out[-1] = out[-1][:-1]
        out.append(sound(c))
    return "".join(out).lower()


def transliterated(texts: Column) -> Column:
    """Transliterated texts, null for null; each distinct text of a batch is done once."""
    letters, lines = sounds()

    @F.pandas_udf(T.StringType())
    def ascii_sounds(texts: pd.Series) -> pd.Series:
        table = _table(letters, lines) if texts.notna().any() else {}
        distinct = {t: transliterate(t, table) for t in texts.dropna().unique()}
        return texts.map(distinct).astype(object).where(texts.notna(), None)

    return ascii_sounds(texts)
