"""Text expressions: tokens, folding, white space, slugs, links."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of white space as Python's str methods know it.
RUN = r"(?U)[\s\x1c-\x1f]+"


@cache
def fold_table() -> tuple[str, str]:
    """Accented Latin letters, of all of Unicode, and the plain letters they decompose to; ligatures, ß and the like stay."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x10000)]
    pairs = [(a, d[0]) for a, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """text without diacritics on Latin letters, composed or combining."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *fold_table())


@cache
def compatible_forms() -> dict[str, str]:
    """What characters that fold leaves are written with, if ASCII letters or digits are part of it: ligatures, full-width and circled signs, and so on."""
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", chr(c).lower()) if not unicodedata.combining(x))
    known = set(fold_table()[0])
    forms = {chr(c): plain(c) for c in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)) if chr(c) not in known}
    return {c: x for c, x in forms.items() if x != c and any(y.isascii() and y.isalnum() for y in x)}


def tokens(text: Column) -> Column:
    """The index terms: lower-case, folded runs of letters and numbers; neither stemmed nor stopped."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrases(text: Column) -> Column:
    """A query's terms, array<array<string>>: each Unicode word as the tokens that the index makes of it."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(F.transform(words, tokens), lambda x: F.size(x) > 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    bare = strip(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, RUN))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalize_ws(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, RUN, " ")))


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(text, 1, size)


def slug_of(title: str, lang: str = "en") -> str:
    """Lower-case ASCII letters and digits joined by hyphens; other languages than English are named at the end."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", title.lower()) if not unicodedata.combining(c))
    parts = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in plain).split()
    return "-".join(parts) + (f"-{lang}" if parts and lang != "en" else "")


def slug(title: Column, lang: Column) -> Column:
    """slug_of as a column. Only in titles that folding leaves with other signs than ASCII are these looked up."""
    known = F.from_json(F.lit(json.dumps(compatible_forms())), "map<string,string>")
    bare = fold(F.lower(title))
    spelled = F.transform(F.regexp_extract_all(bare, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.coalesce(F.try_element_at(known, c), c)))
    bare = F.when(bare.rlike(r"[^\x00-\x7F]"), F.array_join(spelled, "")).otherwise(bare)
    bare = F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when((lang == "en") | (bare == ""), bare).otherwise(F.concat(bare, F.lit("-"), lang))


def percent_encoded(text: Column) -> Column:
    """As in a URL's path: letters, digits and _.-~/ stay, all else is percent-encoded UTF-8."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def permalink_of(lang: str, title: str, revid: int | None) -> str:
    if revid is None:
        raise ValueError(f"{lang}:{title} has no pinned revision")
    return f"https://{lang}.wikipedia.org/w/index.php?title={quote(title.replace(' ', '_'))}&oldid={revid}"
