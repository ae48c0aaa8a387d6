"""Token pattern and token features, as expressions that Spark evaluates itself.

The pattern is one ordered alternation without lookaround. Short forms and kept hyphens stand in for a lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: alternatives in order, by the type of token they make
ALTERNATIVES = (
    ("emoji", r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"),
    ("tabCRLF", r"[\n\r\t]+"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("url", r"(?:https?://|www\.)[^\s]+"),
    ("emoticon", r"[:;=][\-]?[\)\(DPp]"),
    ("mention", r"@[A-Za-z0-9_]+"),
    ("hashtag", r"#[\p{L}_][\p{L}\p{N}_]*"),
    ("decade", r"'\d0s\b"),
    ("time", r"\d{1,2}(?::\d{2})?(?:am|pm|AM|PM)\b"),
    ("ordinal", r"\d+(?:st|nd|rd|th)\b"),
    ("word", r"(?:[A-Za-z]\.)+(?:[A-Za-z]\b)?|(?:Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|St)\."),
    ("word", r"[\p{L}]+-\d+\b|(?i:e-[\p{L}]+)|[\p{L}]+-(?i:less|like|wide|free)\b|AT&T"),
    ("number", r"\d+(?:[.,/:\-]\d+)*"),
    ("word", r"[A-Za-z]+[nN]'[tT]\b"),
    ("word", r"(?i:n't|'s|'ll|'ve|'re|'d|'m)\b"),
    ("word", r"[\p{L}\p{M}][\p{L}\p{M}\p{N}]*"),
    ("punctuation", r"[^\s\x{A0}\x{2002}-\x{2005}\x{2009}\x{200A}\x{202F}\x{205F}]"),
)
PATTERN = "|".join(p for _, p in ALTERNATIVES)
#: The same tokens, found sooner: a run of letters that no other alternative could begin or go on from is a word.
QUICK = r"\p{L}++(?![\p{M}\p{N}._%+\-@:/&'])|\p{L}{5,}+(?=\.(?:\s|\z))|" + PATTERN
SYMBOLS = "*$%^&+=<>|~@#"
NEGATED = r"(?i)^.+n't$"

#: Tests of a token's type in order; the first that matches the whole token decides.
TYPES = (
    ("emoji", r"^[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]$"),
    ("tabCRLF", r"^[\n\r\t]+$"),
    ("email", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+$"),
    ("url", r"^(?:https?://|www\.)[^\s]+$"),
    ("emoticon", r"^[:;=][\-]?[\)\(DPp]$"),
    ("mention", r"^@[A-Za-z0-9_]+$"),
    ("hashtag", r"^#[\p{L}_][\p{L}\p{N}_]*$"),
    ("decade", r"^'\d0s$"),
    ("time", r"^\d{1,2}(?::\d{2})?(?:am|pm|AM|PM)$"),
    ("ordinal", r"^\d+(?:st|nd|rd|th)$"),
    ("number", r"^\d+(?:[.,/:\-]\d+)*$"),
    ("word", r"[\p{L}\p{M}]"),
    ("symbol", r"^[*$%^&+=<>|~@#]$"),
)
# accents that decompose to a base letter, for shapes
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
SHAPES = (("[A-Z]{4,}", "\x01\x01\x01\x01"), ("[A-Z]", "\x01"), ("[a-z]{4,}", "\x02\x02\x02\x02"), ("[a-z]", "\x02"), (r"\d{4,}", "\x03\x03\x03\x03"), (r"\d", "\x03"))


def let(value: Column, body) -> Column:
    """body of a value that is found once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """The tokens of a text; a word ending in n't is two. Null: null."""
    found = F.regexp_extract_all(text, F.lit(QUICK), F.lit(0))
    halves = F.flatten(F.transform(found, lambda t: F.when(t.rlike(NEGATED), F.array(F.substring(t, 1, F.length(t) - 3), F.right(t, F.lit(3)))).otherwise(F.array(t))))
    return F.when(text.rlike("(?i)n't"), halves).otherwise(found)


def spaced_tokens(text: Column) -> Column:
    """The tokens of a text as structs of value and spaces, the white space before it. Null: null."""
    both = rf"([\s\x{{A0}}\x{{2002}}-\x{{2005}}\x{{2009}}\x{{200A}}\x{{202F}}\x{{205F}}]*?)({PATTERN})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), F.lit(1)).alias("spaces"), F.regexp_extract_all(text, F.lit(both), F.lit(2)).alias("value"))
    one = lambda spaces, value: F.struct(value.alias("value"), spaces.alias("spaces"))

    def split(p: Column) -> Column:
        t = p["value"]
        halves = F.array(one(p["spaces"], F.substring(t, 1, F.length(t) - 3)), one(F.lit(""), F.right(t, F.lit(3))))
        return F.when(t.rlike(NEGATED), halves).otherwise(F.array(one(p["spaces"], t)))

    return F.flatten(F.transform(pairs, split))


def type_of(token: Column) -> Column:
    """The type of a token: most are letters alone, or a common sign, and need no other test."""
    out = F.lit("punctuation")
    for name, pattern in reversed(TYPES):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(token.rlike(r"^\p{L}+$"), "word").when(token.isin(*".,!?-()'\""), "punctuation").otherwise(out)


def case_of(token: Column) -> Column:
    return F.when(token.rlike(r"^[A-Z][A-Z\-–—.]*$"), "upperCase").when(token.rlike(r"^[a-z][a-z\-–—.]*$"), "lowerCase").when(token.rlike(r"^[A-Z][a-z\-–—.]*$"), "titleCase").otherwise("other")


def shape_of(token: Column) -> Column:
    out = F.translate(token, ACCENTED, PLAIN)
    for pattern, sign in SHAPES:
        out = F.regexp_replace(out, pattern, sign)
    return F.translate(out, "\x01\x02\x03", "Xxd")


def prefix_of(token: Column) -> Column:
    return F.substring(token, 1, 2)


def suffix_of(token: Column) -> Column:
    return F.right(token, F.lit(3))


def is_abbreviation(token: Column) -> Column:
    return token.rlike(r"(?i)^[a-z].*\.$")


def normal_of(token: Column) -> Column:
    """Lower case, with the second half of a contraction spelt out."""
    from textloom.functions.lexicon import NORMALS

    low = F.lower(token)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NORMALS.items() for x in kv]), low), low)
