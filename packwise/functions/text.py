"""Text helpers with Unicode-aware whitespace, shared by all stages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every Unicode whitespace character, separators 0x1c-0x1f included. Printable ASCII is
# ruled out first: it is the common case, and the rest of the class is slow to test.
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[[^!-~]&&[{SPACES}]]"
ODD_SPACE = f"[[^ -~]&&[{SPACES}]]"
NON_SPACE = f"[!-~]|[^{SPACES}]"
#: The same characters themselves.
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACES}]", c))


def strip(text: Column) -> Column:
    """Without white space at the ends; printable ASCII there, also beside plain blanks, needs no search."""
    plain = F.trim(text)
    return F.when(_starts_plain(text) & _starts_plain(text, -1), text).when(
        _starts_plain(plain) & _starts_plain(plain, -1), plain).otherwise(F.btrim(text, F.lit(SPACE_CHARACTERS)))


def strip_found(text: Column) -> Column:
    """The same for a text that is costly to find: it is asked for once, as ``strip`` names it ten times."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def _starts_plain(text: Column, place: int = 1) -> Column:
    """The character at one end is printable ASCII."""
    return F.substring(text, place, 1).between("!", "~")


def strips_to_text(text: Column) -> Column:
    """``strip`` leaves something, as the first character mostly tells."""
    return F.when(_starts_plain(text), F.lit(True)).otherwise(strip(text) != "")


def collapse(text: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed.

    Tidy text, the common case, is told by plain searches and one class; only the rest is rewritten.
    """
    blank = F.lit(" ")
    untidy = (F.startswith(text, blank) | F.endswith(text, blank) | F.contains(text, F.lit("  "))
              | text.rlike(ODD_SPACE))
    return F.when(untidy, F.trim(F.regexp_replace(text, SPACE + "+", " "))).otherwise(text)


def collapse_found(text: Column) -> Column:
    """The same for a text that is costly to find and short: it is asked for once, as ``collapse`` names it five times."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def normalize_key(text: Column) -> Column:
    return F.lower(collapse(text))


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(NON_SPACE), F.lit(False))


def is_blank(text: Column) -> Column:
    return ~has_text(text)


def is_filled(text: Column) -> Column:
    """Not null and not the empty string; blanks count as filled."""
    return F.coalesce(text != "", F.lit(False))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_value(*columns: Column) -> Column:
    """First column that is neither null nor the empty string."""
    return F.coalesce(*[empty_to_null(c) for c in columns])


def to_bool(value: Column, default: bool = False) -> Column:
    """Printed booleans; any other non-empty text is true."""
    word = F.lower(strip(value))
    return (
        F.when(value.isNull(), F.lit(default))
        .when(word.isin("true", "yes", "1", "y"), F.lit(True))
        .when(word.isin("false", "no", "0", "n", ""), F.lit(False))
        .otherwise(F.lit(True))
    )


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null where the pattern does not match or the group is empty."""
    return empty_to_null(F.regexp_extract(text, pattern, group))


def first_match(patterns: list[str], text: Column) -> Column:
    """First pattern whose group 1 is non-empty, whitespace collapsed."""
    return collapse_found(F.coalesce(*[extract(text, p) for p in patterns]))


#: What else case-insensitive patterns take for an ASCII letter, and that letter.
FOLDED = {"İ": "i", "ı": "i", "ſ": "s", "\u212a": "k"}


def folded(text: Column, lower: Column | None = None) -> Column:
    """Lower case such that ASCII words that a case-insensitive pattern finds stand there as they are.

    ``lower`` is the text in lower case, if it is there already: it is the folded one of a text without odd letters.
    """
    found = F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values())))
    if lower is None:
        return found
    odd = [F.contains(text, F.lit(letter)) for letter in FOLDED]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], found).otherwise(lower)


def contains_any(text: Column, phrases) -> Column:
    """Any literal phrase occurs; one pass over the text."""
    return F.coalesce(text.rlike("|".join(re.escape(p) for p in phrases)), F.lit(False))


def matches_any(text: Column, patterns) -> Column:
    hit = text.rlike(patterns[0])
    for pattern in patterns[1:]:
        hit = hit | text.rlike(pattern)
    return F.coalesce(hit, F.lit(False))


def fixed_decimals(number: Column, digits: int) -> Column:
    """Fixed-point text, ties to even on the exact binary value."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", number, F.lit(pattern))


def round_exact(number: Column, digits: int) -> Column:
    """Round to even on the exact binary value (``round`` works on the printed value)."""
    return fixed_decimals(number, digits).cast("double")


def ordered_bits(number: Column) -> Column:
    """The 64 bits of a positive double as a whole number, which has the same order; NaN and infinity count as
    the largest finite one."""
    number = F.least(number, F.lit(1.7976931348623157e308))
    guess = F.greatest(F.floor(F.log2(number)), F.lit(-1022))
    scaled = number / F.pow(F.lit(2.0), guess)
    power = F.greatest(guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0), F.lit(-1022))
    fraction = ((number / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("bigint")
    return (power + 1023) * F.lit(1 << 52) + fraction


def clamp01(number: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def lookup(key: Column, pairs: dict[str, str]) -> Column:
    """Literal map lookup that keeps unknown keys."""
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), key), key)


# Zeros of the decimal digits of other scripts, each the first of ten in a row.
ZEROS = ("٠", "۰", "߀", "०", "০", "੦", "૦", "୦", "௦", "౦", "೦", "൦", "๐", "໐", "༠", "၀", "０")
_DIGITS = "".join(chr(ord(zero) + i) for zero in ZEROS for i in range(10))


def ascii_digits(text: Column) -> Column:
    """Decimal digits of other scripts as those of ASCII."""
    return F.translate(text, _DIGITS, "0123456789" * len(ZEROS))
