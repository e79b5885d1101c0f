"""Fill-in-middle order of texts by counted-quantifier patterns, in DataFrame functions only.

A text is a row of units (a run of ASCII letters, or one other code point). ``regexp_count`` gives
their number n; two numbers that follow from the document's id cut them at a <= b. One pattern a
row, with possessive groups ``unit{a}`` and ``unit{b-a}``, then captures prefix, middle and suffix
in one match, which ``regexp_replace`` puts into the new order. Possessive groups keep no way back,
so a match takes time linear in the text and no stack, however long the text.

Nothing moves: every row is made where it is read, from its id and text alone, so a run that is
repeated gives the same rows.

Defined results: null text counts as empty; empty texts, texts that contain a mark and the share
that ``plain`` names stay as they are; a null doc_id is drawn for as an empty number; rows of one
doc_id draw the same numbers, each for its own n; an empty table stays empty; other columns are
kept, and new ones take longer names where they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.llm.common import col, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same units without a way back.
HELD_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
#: Percent of documents that are transformed at all, and of those the percent with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def draws(doc_id: Column, seed: str = "1:") -> list[Column]:
    """Four 32-bit numbers of a document: the first groups of eight digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(docs: DataFrame, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form, output, prefix_chars and middle_chars (longer names on a clash).

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    """
    n, form, output, prefix_chars, middle_chars, whole, a, b, third, fourth = fresh(
        docs, "n", "form", "output", "prefix_chars", "middle_chars", "_whole", "_a", "_b", "_third", "_fourth")
    h1, h2, h3, h4 = draws(col("doc_id"))
    cut = [h % (F.col(n) + 1) for h in (h1, h2)]
    out = docs.withColumn(whole, F.coalesce(col("text"), F.lit("")))
    out = out.withColumn(n, F.regexp_count(F.col(whole), F.lit(UNIT)).cast("long"))
    out = out.withColumns({a: F.least(*cut), b: F.greatest(*cut), third: h3, fourth: h4})
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col(whole), F.lit(mark))
    plain = (F.col(n) == 0) | marked | (F.col(third) % 100 >= transformed)
    out = out.withColumn(form, F.when(plain, "plain").when(F.col(fourth) % 100 < suffix_first, "spm").otherwise("psm"))
    pattern = F.concat(
        F.lit(f"(?s)\\A({HELD_UNIT}{{"), F.col(a), F.lit(f"}}+)({HELD_UNIT}{{"), F.col(b) - F.col(a), F.lit("}+)(.*+)\\z"))
    order = F.when(F.col(form) == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    made = F.when(F.col(form) == "plain", F.col(whole)).otherwise(F.regexp_replace(F.col(whole), pattern, order))
    out = out.withColumn(output, made)
    parts = parts_of(F.col(output), F.col(form))
    chars = [F.char_length(parts[k]).cast("long") for k in ("prefix", "middle")]
    return out.withColumns({prefix_chars: chars[0], middle_chars: chars[1]}).select(
        *map(col, docs.columns), n, form, output, prefix_chars, middle_chars)


def parts_of(output: Column, form: Column) -> dict[str, Column]:
    """prefix, middle and suffix of an output, found by its marks; null where the form is plain.

    The parts hold no mark (such texts stay plain), so each mark stands once, and what a part and
    a mark form together can't be another one: every mark begins with its only ``<``.
    """
    def piece(text: Column, mark: str, which: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(which))

    body = F.substring(output, len(PREFIX) + 1, 2147483647)  # without the first mark
    first, rest = {}, {}
    for name, mark in (("psm", SUFFIX), ("spm", PREFIX)):
        first[name], rest[name] = piece(body, mark, 1), piece(body, mark, 2)
    return {
        "prefix": F.when(form == "psm", first["psm"]).when(form == "spm", piece(rest["spm"], MIDDLE, 1)),
        "middle": F.when(form == "psm", piece(rest["psm"], MIDDLE, 2)).when(form == "spm", piece(rest["spm"], MIDDLE, 2)),
        "suffix": F.when(form == "psm", piece(rest["psm"], MIDDLE, 1)).when(form == "spm", first["spm"]),
    }


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone."""
    parts = parts_of(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(parts["prefix"], parts["middle"], parts["suffix"]))
