"""Column expressions for text: tokens, canonical forms, digests, measures and property names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words, and those that count as white space.
SEPARATORS = " -)(;,（），、；。：的"
SEPARATOR_CLASS = "[ \\-)(;,（），、；。：的]"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Short property names and what they are called in a revision list.
PROPERTY_NAMES = {
    "b": "bold", "bCs": "boldComplex", "i": "italic", "iCs": "italicComplex", "u": "underline", "strike": "strikethrough", "dstrike": "doubleStrikethrough",
    "sz": "fontSize", "szCs": "fontSizeComplex", "rFonts": "font", "color": "color", "highlight": "highlight", "shd": "shading", "vertAlign": "verticalAlign",
    "caps": "allCaps", "smallCaps": "smallCaps", "outline": "outline", "shadow": "shadow", "emboss": "emboss", "imprint": "imprint", "vanish": "hidden",
    "spacing": "characterSpacing", "w": "characterWidth", "kern": "kerning", "position": "position",
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def separated(c: Column) -> Column:
    """Parts between separators, empty ones included."""
    return F.split(c, SEPARATOR_CLASS, -1)


def tokens(c: Column) -> Column:
    """Non-empty parts between separators, in order."""
    return F.filter(separated(c), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def count_words(c: Column) -> Column:
    return F.size(tokens(c))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE_CLASS, "")


def content_score(c: Column) -> Column:
    """How many characters are neither separators nor white space."""
    return F.length(F.regexp_replace(strip_space(c), SEPARATOR_CLASS, ""))


def letter_tokens(c: Column) -> Column:
    """Runs of letters and digits, ASCII letters in lower case."""
    return F.filter(F.split(ascii_lower(c), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def significant(c: Column, least: int = 4) -> Column:
    return F.filter(letter_tokens(c), lambda t: F.length(t) >= least)


def body_tokens(tokens: Column) -> Column:
    """Tokens of three letters or more that are no stamp of a file."""
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.startswith(t, F.lit("file_")) & ~t.isin("doc", "docx"))


def shared_connectors(a: Column, b: Column) -> Column:
    """How many of the connecting words both sides hold."""
    return F.size(F.array_intersect(F.array_intersect(a, b), F.array(*map(F.lit, ("and", "the", "for")))))


def ordered_prefix(a: Column, b: Column, least: int = 4) -> Column:
    """How many tokens, short ones left out, are the same on both sides from the first on."""
    long = lambda c: F.filter(c, lambda t: F.length(t) >= least)
    same = F.zip_with(long(a), long(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Of two token sets; `empty` is the value of two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def atom_hash(kind: str, c: Column) -> Column:
    """Digest of one piece of content: its kind, then its text with spaces made unbreakable."""
    return F.sha1(F.concat(F.lit(kind), F.translate(c, " ", " ")))


def digest_of_digests(hashes: Column) -> Column:
    return F.sha1(F.array_join(hashes, ""))


def twips(number: Column, unit: Column) -> Column:
    """A length in twentieths of a point; null for an unknown unit."""
    factor = F.when(unit == "pt", 20.0).when(unit == "in", 1440.0).when(unit == "cm", 1440 / 2.54).when(unit == "mm", 1440 / 25.4).when(unit.isin("pc", "pi"), 240.0)
    return F.round(number * factor).cast("long")


def friendly_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROPERTY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


def decode_entities(c: Column) -> Column:
    for entity, sign in (("&quot;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c
