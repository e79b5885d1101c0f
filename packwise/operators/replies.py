"""Model replies landed as a table: JSON parsing, defaults, printed-price repair, retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.operators.evidence import rank_in
from packwise.schemas import (
    BOOLEAN_FIELDS, LABEL_FIELDS, TEXT_FIELDS, VIEWS, label_field_default,
)

# The text fields that make an extraction usable.
USABLE_FIELDS = tuple(f for f in TEXT_FIELDS if f != "unit_sale_price")

NOTHING_USABLE = (
    "LLM extraction returned no usable label fields on any view. "
    "No compliance score was generated."
)

# Patterns and unit spellings of printed prices.
BARE_NUMBER = r"(?U)^\d+(?:\.\d+)?$"
MRP_MENTION = r"(?idU)\bM\s*\.?\s*R\s*\.?\s*P\b.{0,120}?(\d+(?:\.\d+)?)"
TAX_MENTION = (
    r"(?iU)inclusive\s+of\s+(?:all\s+)?(?:the\s+)?taxes|incl\.?\s+of\s+(?:all\s+)?taxes"
)
CURRENCY_MENTION = r"(?iU)(₹|rs\.?|inr|rupee)"
UNITS = "kg|kgs|g|gm|gms|l|ltr|litre|litres|ml"
USP_AFTER_UNIT = (
    rf"(?idU)\bUSP\b\s*.*?(?:per|/)\s*({UNITS})\b\s*(?:[:\-]?\s*)(\d+(?:\.\d+)?)"
)
USP_WITH_CURRENCY = rf"(?iU)(₹|rs\.?|inr)\s*(\d+(?:\.\d+)?)\s*(?:per|/)\s*({UNITS})\b"
UNIT_SYMBOLS = {
    "kgs": "kg", "gm": "g", "gms": "g", "litre": "L", "litres": "L", "l": "L",
    "ltr": "L", "ml": "ml",
}


def _listed(text: Column) -> Column:
    """The text as the one element of a JSON array, so that nothing may follow its value."""
    return F.concat(F.lit("["), text, F.lit("\n]"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names more than once: the expression holds the value once, however it grows."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _object(text: Column) -> Column:
    """The map of a text that is one JSON object and nothing else, else null; the last of equal keys counts."""
    def last_of_equal(whole: Column) -> Column:
        names = F.array_distinct(F.map_keys(whole))
        last = F.transform(names, lambda k: F.element_at(
            F.filter(F.map_entries(whole), lambda e: e["key"] == k), -1)["value"])
        return F.when(F.size(names) < F.size(F.map_keys(whole)), F.map_from_arrays(names, last)).otherwise(whole)

    parts = F.from_json(_listed(text), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    alone = _once(parts, lambda p: F.when(F.size(p) == 1, p[0]))
    return _once(F.when(text.startswith("{") & text.endswith("}"), alone), last_of_equal)


def reply_object(reply: Column) -> Column:
    """Reply text -> key/value map; null when no JSON object can be read.

    Thinking blocks are dropped. A text that is JSON is taken as it is; else what stands from
    the first to the last brace must be one object. The reply is named once, each step's result, too:
    the expression grows with the steps, not with their product.
    """
    def read(body: Column) -> Column:
        span = F.regexp_extract(body, r"(?s)\{.*\}", 0)
        other = ~body.startswith("{") & (F.json_array_length(_listed(body)) == 1)
        return F.when(~F.coalesce(other, F.lit(False)), F.coalesce(_object(body), _once(span, _object)))

    return _once(tx.strip_found(F.regexp_replace(tx.strip_found(reply), r"(?is)<think>.*?</think>", "")), read)


def parse_replies(df: DataFrame, reply: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a readable reply (column ``parsed``), and the rest with the reason.

    A reply is read in a generator of one row, which no filter moves below: it is read once a frame, and what made it
    isn't put into the condition.
    """
    parsed = df.withColumn("parsed", F.explode(F.array(reply_object(F.col(reply)))))
    reason = F.when(tx.is_blank(F.col(reply)), "empty content").otherwise("no JSON object")
    return (
        parsed.filter("parsed is not null"),
        parsed.filter("parsed is null").withColumn("reason", reason).drop("parsed"),
    )


def fill_defaults(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Typed fields of a parsed reply.

    A missing key gets the default; an explicit null stays null.
    """
    reply = F.col(parsed)
    added = {}
    for name in LABEL_FIELDS:
        value = F.try_element_at(reply, F.lit(name))
        if name in BOOLEAN_FIELDS:
            value = F.when(value.isNotNull(), tx.to_bool(value))
        added[name] = F.when(
            F.map_contains_key(reply, name), value
        ).otherwise(label_field_default(name))
    return df.withColumns(added)


def rebuild_mrp(mrp: Column, text: Column) -> Column:
    """A bare number becomes the printed declaration found in the label text."""
    flat = tx.collapse(text)
    mention = tx.extract(flat, MRP_MENTION, 0)
    price = F.regexp_extract(flat, MRP_MENTION, 1)
    currency = tx.extract(mention, CURRENCY_MENTION, 1)
    printed = (
        F.when(
            mention.rlike(TAX_MENTION),
            F.concat(F.lit("MRP ₹"), price, F.lit(" (Inclusive of all taxes)")),
        )
        .when(currency.isNotNull(), F.concat(F.lit("MRP "), currency, F.lit(" "), price))
        .otherwise(F.concat(F.lit("MRP "), price))
    )
    bare = tx.strip(mrp).rlike(BARE_NUMBER) & mention.isNotNull()
    return F.when(bare, printed).otherwise(mrp)


def rebuild_unit_price(price: Column, text: Column) -> Column:
    """A bare number becomes ``<currency> <price> per <unit>`` from the label text."""
    flat = tx.collapse(text)
    unit = F.lower(tx.extract(flat, USP_AFTER_UNIT, 1))
    known = unit.isin(*UNIT_SYMBOLS)
    after_unit = F.concat(
        F.lit("₹"), F.regexp_extract(flat, USP_AFTER_UNIT, 2), F.lit(" per "),
        tx.lookup(unit, UNIT_SYMBOLS),
    )
    currency = tx.extract(flat, USP_WITH_CURRENCY, 1)
    printed_unit = F.regexp_extract(flat, USP_WITH_CURRENCY, 3)
    symbol = F.when(
        F.lower(printed_unit).isin(*UNIT_SYMBOLS), tx.lookup(F.lower(printed_unit), UNIT_SYMBOLS)
    ).otherwise(printed_unit)
    with_currency = F.concat(
        currency, F.lit(" "), F.regexp_extract(flat, USP_WITH_CURRENCY, 2),
        F.lit(" per "), symbol,
    )
    found = F.coalesce(F.when(known, after_unit), with_currency)
    bare = tx.strip(price).rlike(BARE_NUMBER)
    return F.when(bare & found.isNotNull(), found).otherwise(price)


def usable(method: Column | None, has_text: Column) -> Column:
    """Not rule-based, readable, and at least one text field is filled."""
    any_field = F.lit(False)
    for name in USABLE_FIELDS:
        any_field = any_field | tx.is_filled(F.col(name))
    if method is None:
        return has_text & any_field
    return F.coalesce(method != "rules", F.lit(True)) & has_text & any_field


def apply_retry(first: DataFrame, retry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take a second extraction where the first gave nothing usable.

    Both frames have one row per (product_id, view) with the 22 fields; ``first`` also has
    ``extraction_method`` and ``has_text``. Returns the views of products with a usable
    view (``recovered`` marks replaced ones) and the failed products with the reason.
    """
    keys = ["product_id", "view"]
    again = retry.select(*keys, F.struct(*LABEL_FIELDS).alias("_retry"))
    both = first.withColumn("_ok", usable(F.col("extraction_method"), F.col("has_text"))).join(
        again, keys, "left"
    )
    retry_filled = F.lit(False)
    for name in USABLE_FIELDS:
        retry_filled = retry_filled | tx.is_filled(F.col(f"_retry.{name}"))
    recovered = ~F.col("_ok") & F.col("has_text") & retry_filled
    judged = both.withColumn("recovered", F.coalesce(recovered, F.lit(False))).withColumns({
        **{
            n: F.when(F.col("recovered"), F.col(f"_retry.{n}")).otherwise(F.col(n))
            for n in LABEL_FIELDS
        },
        "extraction_method": F.when(F.col("recovered"), "llm_retry").otherwise(
            F.col("extraction_method")
        ),
        "_ok": F.col("_ok") | F.col("recovered"),
    })
    products = judged.groupBy("product_id").agg(F.max("_ok").alias("_any"))
    failed = products.filter("not _any").select(
        "product_id", F.lit(NOTHING_USABLE).alias("reason")
    )
    kept = judged.join(products.filter("_any"), "product_id", "left_semi")
    return kept.drop("_ok", "_retry"), failed


def retry_warnings(views: DataFrame) -> DataFrame:
    """Warning text per product with recovered views, views in display order."""
    recovered = views.filter("recovered")
    names = F.array_sort(F.collect_set(F.struct(
        rank_in(F.col("view"), VIEWS).alias("rank"), "view"
    )))
    return recovered.groupBy("product_id").agg(F.concat(
        F.lit("LLM extraction was retried successfully for: "),
        F.array_join(F.transform(names, lambda v: v["view"]), ", "), F.lit("."),
    ).alias("warning"))
