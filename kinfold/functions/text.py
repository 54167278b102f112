"""Name keys as column expressions: normalised form, basename, acronym, domain stem."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
import pyspark.sql.functions as F
import pyspark.sql.types as T

STOP_WORDS = frozenset(
    """a an and are as at be been but by can con could das de del der des did die do does du el en et for from für
    fur had has have in into is it its la las le les los may mit not o oder of on or ou por shall should that the
    these this those to una und uno von was were will with would y""".split()
)

#: Legal forms that end a company's name, as words of its normalised form.
LEGAL_FORMS = (
    "incorporated", "corporation", "company", "limited", "l l c", "l l p", "p l c", "s p a", "s a r l", "s r l", "g m b h", "pty ltd", "co ltd",
    "gmbh", "sarl", "corp", "pvt", "pty", "plc", "llc", "llp", "ltd", "inc", "spa", "srl", "oyj", "asa", "aps", "kg", "ag", "sa", "nv", "bv",
    "ab", "oy", "lp", "co", "se", "as", "kk", "s a", "n v", "b v",
)

_COUNTRY = "ar at au be br ca ch cl cn cz de dk es fi fr hk ie in it jp kr mx nl no nz pl pt ru se sg tw uk us".split()
DOMAIN_ENDS = sorted(
    [f".{c}" for c in [*_COUNTRY, "ai", "co", "com", "edu", "gov", "io", "net", "org"]] + [".co." + c for c in ("in", "jp", "uk")] + [".com." + c for c in ("au", "br", "mx")],
    key=lambda s: (-len(s), s),
)

#: Letters that lose their marks without leaving the JVM. `exact=True` covers all of Unicode.
_MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xC0, 0x250)}
_SINGLE = {k: "".join(x for x in v if not unicodedata.combining(x)) for k, v in _MARKED.items()}
_FROM = "".join(k for k, v in _SINGLE.items() if len(v) == 1 and v != k)
_TO = "".join(v for k, v in _SINGLE.items() if len(v) == 1 and v != k)


@F.pandas_udf(T.StringType())
def _unmarked(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_name(name: Column, exact: bool = False) -> Column:
    """Lower case without marks, punctuation as spaces, white space collapsed. NULL stays NULL.

    All in the JVM for Latin letters with marks; `exact` adds an Arrow batch step that decomposes
    any script.
    """
    # Letters of ASCII have no marks; what is no word character is a space or becomes one, so a run is one match.
    plain = _unmarked(name) if exact else F.when(name.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(name, _FROM, _TO), r"\p{M}+", "")).otherwise(name)
    return F.trim(F.regexp_replace(F.lower(plain), r"(?U)\W+", " "))


def basename(name: Column) -> Column:
    """The name without its legal form ("Apple Inc." gives "Apple"); repeated forms all go. A name
    that is nothing but a legal form stays."""
    forms = "|".join(r"\.?\s*".join(f.split()) if " " in f else f for f in sorted(LEGAL_FORMS, key=len, reverse=True))
    cut = F.regexp_replace(F.trim(name), rf"(?iU)(?:[\s,]+(?:{forms})\b\.?)+[\s,.]*$", "")
    return F.when(cut == "", F.trim(name)).otherwise(cut)


def corporate_ending(name: Column) -> Column:
    """What `basename` takes away."""
    return F.trim(F.substr(F.trim(name), F.length(basename(name)) + F.lit(1)))


def acronym(name: Column, exact: bool = False) -> Column:
    """Initials of the basename's words in upper case, without stop words and single letters; NULL
    for fewer than two words."""
    kept = F.filter(F.split(normalize_name(basename(name), exact), " "), lambda w: (F.length(w) > 1) & ~w.isin(*sorted(STOP_WORDS)))
    letters = F.upper(F.array_join(F.transform(kept, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.size(kept) >= 2, letters)


def strip_domain(name: Column) -> Column:
    """The name without its domain ending, the longest that fits; case stays."""
    ends = "|".join(e.replace(".", r"\.") for e in DOMAIN_ENDS)
    return F.trim(F.regexp_replace(name, rf"(?i)(?:{ends})$", ""))


def name_keys(name: Column) -> Column:
    """All blocking keys of a name, each once: normalised, basename, domain stem, acronym."""
    made = F.array(normalize_name(name), normalize_name(basename(name)), normalize_name(strip_domain(name)), acronym(name))
    return F.array_distinct(F.filter(made, lambda k: k.isNotNull() & (k != "")))
