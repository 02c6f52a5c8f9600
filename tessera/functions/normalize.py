"""Names and addresses to comparable forms, as built-in column expressions.

Letters of Latin scripts lose their marks by table, composed or not. Only texts with letters of other scripts go through
Python (``translit``), in Arrow batches; all others reach it as null.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.translit import transliterated

_NAMED = re.compile("LATIN SMALL LETTER (?:DOTLESS )?([A-Z])(?: WITH .*)?$")


def _base(c: str) -> str:
    """The plain letter of a small Latin letter with marks, else empty."""
    first = unicodedata.normalize("NFKD", c)[0]
    named = _NAMED.match(unicodedata.name(c, ""))
    return first if "a" <= first <= "z" else named[1].lower() if named else ""


# Small letters of Latin-1, Latin Extended-A, -B and Additional, and what they fold to.
_SMALL = [c for c in map(chr, (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))) if c.islower() and _base(c)]
FOLD_FROM, FOLD_TO = "".join(_SMALL), "".join(map(_base, _SMALL))
FOLD_TWO = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d"), ("ŋ", "ng")]
MARKS = r"[\u0300-\u036F]"
#: A letter or number beyond the Latin scripts.
BEYOND = r"(?=[\p{L}\p{N}])[^\x00-\u024F\u1E00-\u1EFF]"
# Patterns of names.
DBA = r"(?i)^.*?\b(?:trading as|doing business as|d/b/a|dba|t/a|aka|a\.k\.a\.?)\s+"
HAS_DBA = r"(?i)\b(?:trading as|doing business as|d/b/a|dba|t/a|aka|a\.k\.a\.?)\s+"
HAS_DOMAIN = r"(?i)\.(?:com|in|net|org|co|fr|us|io|biz|info)\b"
DOMAIN = r"(?:www\.)?([a-z0-9-]+)\.(?:com|in|net|org|co|fr|us|io|biz|info)\b"
NOISE = r"\b(?:services?|servic|centers?|centres?)\b|[0-9]{7,}"
HONORIFIC = r"^(?:mr|mrs|ms|dr|messrs|m s|shri|smt)\s+"
# Legal forms, also French and transliterated.
LEGAL = (
    "private pvt limited ltd llc llp pllc plc lp inc incorporated corporation corp co company pc "
    "sarl sas sasu sa eurl sci snc gmbh "
    "societe cie etablissements ets association asso syndicat "
    "praivet praivt privet prayvet limitad limitd lmtd limiteda elelpi pra li"
).split()
# Phonetic merges of the skeleton, in this order.
MERGES = [("ph", "f"), ("th", "t"), ("sh", "s"), ("ch", "k"), ("ck", "k"), ("c", "k"), ("q", "k"), ("z", "s"), ("w", "v"), ("x", "ks"), ("j", "g"), ("m", "n"), ("h", "")]
# Address words and their short forms, as pairs.
US_STATES = (
    "alabama al alaska ak arizona az arkansas ar california ca colorado co connecticut ct "
    "delaware de florida fl georgia ga hawaii hi idaho id illinois il indiana in iowa ia "
    "kansas ks kentucky ky louisiana la maine me maryland md massachusetts ma michigan mi "
    "minnesota mn mississippi ms missouri mo montana mt nebraska ne nevada nv ohio oh "
    "oklahoma ok oregon or pennsylvania pa tennessee tn texas tx utah ut vermont vt "
    "virginia va washington wa wisconsin wi wyoming wy"
)
INDIAN_STATES = (
    "maharashtra mh karnataka ka gujarat gj rajasthan rj kerala kl telangana tg bihar br "
    "odisha od orissa od punjab pb haryana hr delhi dl jharkhand jh chhattisgarh cg "
    "uttarakhand uk goa ga assam as"
)
CITIES = "calcutta kolkata bombay mumbai madras chennai bangalore bengaluru gurgaon gurugram poona pune baroda vadodara trivandrum thiruvananthapuram mysore mysuru"
STREETS = (
    "street st str st saint st sainte ste avenue ave av ave road rd court ct crt ct "
    "boulevard blvd bd blvd bld blvd drive dr lane ln place pl highway hwy parkway pkwy "
    "circle cir terrace ter square sq trail trl apartment apt suite ste floor fl "
    "building bldg sector sec sect sec chemin ch route rte allee all impasse imp "
    "passage pass cours crs quai q north n south s east e west w first 1st second 2nd "
    "third 3rd fourth 4th fifth 5th sixth 6th seventh 7th eighth 8th ninth 9th tenth 10th"
)
# Address phrases and their short forms, in this order.
PHRASES = [
    ("new york", "ny"), ("new jersey", "nj"), ("new mexico", "nm"), ("new hampshire", "nh"),
    ("north carolina", "nc"), ("north dakota", "nd"), ("south carolina", "sc"),
    ("south dakota", "sd"), ("west virginia", "wv"), ("rhode island", "ri"),
    ("district of columbia", "dc"), ("west bengal", "wb"), ("uttar pradesh", "up"),
    ("madhya pradesh", "mp"), ("andhra pradesh", "ap"), ("himachal pradesh", "hp"),
    ("tamil nadu", "tn"), ("jammu and kashmir", "jk"), ("jammu kashmir", "jk"),
    ("ile de france", "idf"),
]
# Address words that go.
ADDRESS_STOPS = "na n/a city near opp opposite behind beside c o h no po ps cedex".split()


# What the earlier lists lack.
EARLIER_HONORIFIC = r"^(?:mr|mrs|ms|dr|messrs|m s)\s+"
LATER_LEGAL = "societe cie etablissements ets association asso syndicat".split()
LATER_SHORT = "sainte passage cours quai".split()
LATER_PHRASES = ["ile de france"]


def short_forms() -> dict[str, str]:
    """Address word to short form."""
    words = f"{US_STATES} {INDIAN_STATES} {CITIES} {STREETS}".split()
    return dict(zip(words[::2], words[1::2], strict=True))


@dataclass(frozen=True)
class Lists:
    """The word lists of one set of rules."""

    honorific: str
    legal: tuple[str, ...]
    short: tuple[tuple[str, str], ...]
    phrases: tuple[tuple[str, str], ...]


LISTS = Lists(HONORIFIC, tuple(LEGAL), tuple(short_forms().items()), tuple(PHRASES))
EARLIER_LISTS = Lists(
    EARLIER_HONORIFIC,
    tuple(w for w in LEGAL if w not in LATER_LEGAL),
    tuple(x for x in short_forms().items() if x[0] not in LATER_SHORT),
    tuple(x for x in PHRASES if x[0] not in LATER_PHRASES),
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold_latin(c: Column) -> Column:
    """Lower case, Latin letters without their marks, whether composed or followed by combining ones."""
    folded = F.translate(F.regexp_replace(F.lower(_text(c)), MARKS, ""), FOLD_FROM, FOLD_TO)
    return reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), FOLD_TWO, folded)


def to_ascii(c: Column) -> Column:
    """Lower case, letters of any script by their ASCII sounds."""
    folded = fold_latin(c)
    return F.coalesce(transliterated(F.when(folded.rlike(BEYOND), folded)), folded)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def strip_dba(c: Column) -> Column:
    return F.regexp_replace(_text(c), DBA, "")


def strip_domain(c: Column) -> Column:
    return F.regexp_replace(c, DOMAIN, "$1")


def strip_noise(c: Column) -> Column:
    return F.regexp_replace(c, NOISE, " ")


def alnum(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def split_dba(c: Column) -> tuple[Column, Column]:
    """(legal name, trade name): what stands before the first marker and what follows it; without a marker all is legal."""
    before = F.regexp_replace(_text(c), f"{HAS_DBA}(?s:.*)$", "")
    trade = F.when(_text(c).rlike(HAS_DBA), strip_dba(c)).otherwise("")
    return F.trim(before), F.trim(trade)


def strip_honorific(c: Column, pattern: str = HONORIFIC) -> Column:
    return F.regexp_replace(c, pattern, "")


def join_initials(c: Column) -> Column:
    """ "l l c" to "llc": a space between two single letters goes."""
    return F.regexp_replace(c, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def drop_legal(c: Column, legal: tuple[str, ...] = LISTS.legal) -> Column:
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(list(legal))), " ")


def norm_name(c: Column, lists: Lists = LISTS) -> Column:
    return drop_legal(join_initials(strip_honorific(alnum(strip_noise(strip_domain(to_ascii(strip_dba(c))))), lists.honorific)), lists.legal)


def name_sort(normed: Column) -> Column:
    return F.array_join(F.array_sort(tokens(normed)), " ")


def acronym(normed: Column) -> Column:
    """First letters of two words or more, else empty."""
    return F.when(F.size(tokens(normed)) > 1, F.array_join(F.transform(tokens(normed), lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def skeleton(c: Column) -> Column:
    """Consonants after phonetic merges, repeats squeezed."""
    merged = reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), MERGES, c)
    return F.regexp_replace(F.regexp_replace(merged, "[aeiouy]", ""), r"(.)\1+", "$1")


def name_skeleton(normed: Column) -> Column:
    return skeleton(F.replace(normed, F.lit(" "), F.lit("")))


def norm_addr(c: Column, lists: Lists = LISTS) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(to_ascii(c), "[^a-z0-9]+", " "), F.lit(" "))
    phrased = reduce(lambda x, ab: F.replace(x, F.lit(f" {ab[0]} "), F.lit(f" {ab[1]} ")), lists.phrases, padded)
    table = F.create_map(*[F.lit(x) for pair in lists.short for x in pair])
    short = F.transform(tokens(phrased), lambda t: F.coalesce(F.try_element_at(table, t), t))
    kept = F.filter(short, lambda t: ~t.isin(ADDRESS_STOPS))
    return F.array_join(F.transform(kept, lambda t: F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t)), " ")


def is_number(t: Column) -> Column:
    return t.rlike("^[0-9]+$")
