"""Declaration fields from label text, as plain string expressions.

Patterns, keyword lists and printed names are fixed values: they decide which text is
found and must stay as they are.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.schemas import LABEL_FIELDS, label_field_default, label_field_type

FLAGS = "(?iU)"


def _at(first: str, pattern: str) -> str:
    """The pattern, asked where one of the characters that it can begin with stands: word boundaries and lists of
    words are slow to test in every place."""
    return f"{FLAGS}(?={first}){pattern}"


NUMBER = r"\d+(?:\.\d+)?"
MASS = r"kg|kgs|kilograms?|g|gm|gms|grams?"
VOLUME = r"ml|millilitres?|milliliters?|l|ltr|litres?|liters?"
QUANTITY_PATTERNS = [
    _at(first, p) for first, p in (
        ("[nq]", r"\b(?:NET\s*(?:QUANTITY|QTY|CONTENT|CONTENTS|WT\.?|WEIGHT|VOL\.?|VOLUME)|QUANTITY|QTY)\b"
         rf"\s*[:\-]?\s*({NUMBER}\s*(?:{MASS}|{VOLUME}|cm|m|nos|no\.?|pieces?|pcs|units?|u|n))\b"),
        ("n", rf"\bNET\b\s*[:\-]?\s*({NUMBER}\s*(?:{MASS}|{VOLUME}|nos|pieces?|pcs|units?))\b"),
        (r"\d", rf"\b({NUMBER}\s*(?:kg|kgs|kilograms?|gm|gms|grams?|millilitres?|milliliters?|"
         r"litres?|liters?))\b"),
        (r"\d", rf"\b({NUMBER}\s*(?:g|kg|ml|l))\b"),
    )
]
# Beside patterns: the words of which one can't be missing from the folded text where they match, if there are such.
QUANTITY_NEEDS = (
    ("net", "quantity", "qty"), ("net",), ("kg", "kilogram", "gm", "gram", "milli", "litre", "liter"), ())
UNIT_WORDS = (
    ("millilitres?|milliliters?", "ml"),
    ("litres?|liters?", "L"),
    ("grams?", "g"),
    ("kilograms?|kgs?", "kg"),
)
PRICE = r"(\d{1,6}(?:\.\d{1,2})?)\b"
CURRENCY = r"₹|rs\.?|inr"
MRP_PATTERNS = [
    _at("m", p) for p in (
        rf"\bM\s*\.?\s*R\s*\.?\s*P\s*\.?\s*[:\-]?\s*(?:{CURRENCY})?\s*{PRICE}",
        rf"\bM\s+R\s+P\b\s*[:\-]?\s*(?:{CURRENCY})?\s*{PRICE}",
        rf"\bMAX(?:IMUM)?\s+RETAIL\s+PRICE\b\s*[:\-]?\s*(?:{CURRENCY})?\s*{PRICE}",
        rf"\bMRP\b.{{0,20}}?(?:{CURRENCY})\s*{PRICE}",
    )
]
MRP_NEEDS = ((), (), ("retail",), ("mrp",))
MRP_WORDING = [
    _at("m", r"\bM\s*\.?\s*R\s*\.?\s*P\s*\.?"),
    _at("m", r"\bMAX(?:IMUM)?\s+RETAIL\s+PRICE\b"),
]
MRP_WORDING_NEEDS = ((), ("retail",))
TAX_WORDING = [
    FLAGS + p for p in (
        r"inclusive\s+of\s+all\s+taxes", r"incl\.?\s+of\s+all\s+taxes",
        r"incl\.?\s+all\s+taxes", r"including\s+all\s+taxes", r"taxes\s+included",
    )
]
TAX_NEEDS = (("inclusive",), ("taxes",), ("taxes",), ("including",), ("included",))
MFG_LABELS = (r"mfd", r"mfg", r"manufactured\s+on", r"date\s+of\s+manufacture", r"pkd",
              r"packed\s+on", r"date\s+of\s+packing")
BEST_BEFORE_LABELS = (r"best\s+before", r"best\s+before\s+end", r"\bb\.?\s*b\.?\b")
USE_BY_LABELS = (r"use\s+by", r"expiry", r"expiry\s+date", r"exp")
# The characters that a date's labels begin with, and the words of which one is there.
DATE_NEEDS = {
    MFG_LABELS: ("[mdp]", ("mfd", "mfg", "manufacture", "pkd", "packed", "packing")),
    BEST_BEFORE_LABELS: ("b", ()),
    USE_BY_LABELS: ("[ue]", ("use", "exp")),
}
EMAIL = FLAGS + r"\b[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
MOBILE = _at("[+6-9]", r"(?:\+91[\s\-]?)?[6-9]\d{9}\b")
GENERIC_NEEDS = (("name",),)
GENERIC_WORDING = [FLAGS + r"(?:product\s+name|generic\s+name)\s*[:\-]\s*([A-Za-z][A-Za-z\s]+)"]
GENERIC_KEYWORDS = (
    ("fruit juice", "Fruit Juice"), ("fruit juices", "Fruit Juices"), ("juice", "Fruit Juice"),
    ("biscuits", "Biscuits"), ("cookies", "Cookies"), ("honey", "Honey"),
    ("shampoo", "Shampoo"), ("toothpaste", "Toothpaste"), ("soap", "Soap"),
    ("detergent", "Detergent"), ("edible oil", "Edible Oil"), ("cooking oil", "Cooking Oil"),
    ("spices", "Spices"), ("tea", "Tea"), ("coffee", "Coffee"), ("milk", "Milk"),
    ("namkeen", "Namkeen"), ("snack", "Snack"),
)
CATEGORY_KEYWORDS = (
    ("food", ("juice", "biscuits", "cookies", "honey", "milk", "tea", "coffee", "namkeen",
              "snack", "food", "flour", "atta", "rice", "spice", "masala", "oil", "beverage",
              "drink")),
    ("cosmetic", ("shampoo", "toothpaste", "soap", "face wash", "cream", "lotion",
                  "moisturizer", "cosmetic")),
    ("electronic", ("charger", "adapter", "earphone", "headphone", "speaker", "battery",
                    "electronic", "power bank")),
)
SPECIFIC_KEYWORDS = {
    "food": (("juice", "fruit_juices"), ("biscuit", "biscuits"), ("cookie", "biscuits"),
             ("honey", "honey"), ("tea", "tea"), ("coffee", "coffee"), ("oil", "edible_oil")),
    "cosmetic": (("shampoo", "shampoo"), ("toothpaste", "toothpaste"), ("soap", "soap")),
    "electronic": (("charger", "charger"), ("adapter", "adapter"), ("battery", "battery")),
}
NAME_STOP_WORDS = (
    "nutrition", "ingredients", "manufactured", "manufactured by", "packed by", "marketed by",
    "consumer care", "customer care", "helpline", "fssai", "lic", "license", "mrp",
    "maximum retail", "best before", "use by", "expiry", "mfd", "mfg", "pkd", "net quantity",
    "net qty", "inclusive of", "all taxes", "barcode", "www.", "http", "@",
)
BRANDS = (
    "tresca", "fresca", "colgate", "britannia", "parle", "nestle", "amul", "dabur",
    "patanjali", "itc", "hindustan unilever", "hul", "pepsodent", "closeup", "sensodyne",
    "vim", "surf", "tide", "ariel", "lux", "dove", "lifebuoy", "clinic plus", "sunsilk",
    "pantene", "loreal", "nivea", "himalaya", "godrej", "tata", "fortune", "saffola", "mdh",
    "everest", "maggi", "knorr", "kissan", "real", "tropicana", "frooti", "bisleri",
    "kinley", "aquafina",
)
UNIT_PRICE_PATTERNS = [
    _at(first, p) for first, p in (
        ("u", rf"(?:unit\s+(?:sale\s+)?price)\s*[:\-]?\s*({CURRENCY})?\s*({NUMBER})\s*(?:/|per)\s*"
         r"(kg|g|l|ml)\b"),
        ("[₹ri]", rf"({CURRENCY})\s*({NUMBER})\s*/\s*(kg|g|l|ml)\b"),
    )
]
UNIT_PRICE_NEEDS = (("price",), ("/",))
MAKER_END = r"(?=(?=[cfleh])\b(?:consumer|customer|fssai|lic|email|helpline)\b|$)"
MAKER_PATTERNS = [
    _at("m", rf"(?:manufactured\s+by|mfd\.?\s*by)\s*[:\-]?\s*(.+?){MAKER_END}"),
    _at("p", rf"(?:packed\s+by|pkd\.?\s*by)\s*[:\-]?\s*(.+?){MAKER_END}"),
]
MAKER_NEEDS = (("manufactured", "mfd"), ("packed", "pkd"))
SHELF_LIFE_WORDING = _at("[sv]", r"\b(?:shelf\s+life|valid\s+for)\b")
SHELF_LIFE_NEEDS = ("shelf", "valid")
ORIGIN_PATTERNS = [
    _at("[cmo]", r"(?:country\s+of\s+origin|made\s+in|origin)\s*[:\-]?\s*([A-Za-z ]+)")
]
ORIGIN_NEEDS = (("origin", "made"),)


def _sought(folded: Column | None, words: tuple[str, ...], found: Column) -> Column:
    """``found``, looked for where one of the words that it needs stands in the folded text; null elsewhere.

    Plain searches take a small part of a pattern's time. Without the folded text everything is looked for.
    """
    if folded is None or not words:
        return found
    return F.when(_has_any(folded, words), found)


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    """One of the words stands in the text, which is named for each: it should be a column that is there already."""
    return functools.reduce(operator.or_, [F.contains(text, F.lit(w)) for w in words])


def _first_match(patterns: list[str], needs: tuple[tuple[str, ...], ...], text: Column, folded: Column | None) -> Column:
    """``first_match`` of the patterns whose needs are met."""
    return tx.collapse_found(F.coalesce(*[_sought(folded, n, tx.extract(text, p)) for p, n in zip(patterns, needs)]))


def _matches_any(patterns: list[str], needs: tuple[tuple[str, ...], ...], text: Column, folded: Column | None) -> Column:
    hits = [_sought(folded, n, text.rlike(p)) for p, n in zip(patterns, needs)]
    return functools.reduce(operator.or_, [F.coalesce(hit, F.lit(False)) for hit in hits])


def normalize_quantity(value: Column) -> Column:
    """Unit words become unit symbols, millilitres first."""
    out = tx.collapse_found(value)
    for words, symbol in UNIT_WORDS:
        out = F.regexp_replace(out, rf"{FLAGS}({NUMBER})\s*({words})", rf"$1 {symbol}")
    return out


def net_quantity(text: Column, tidy: Column | None = None, folded: Column | None = None) -> Column:
    """``tidy`` is the collapsed text and ``folded`` the folded one, here and below, if they are there already."""
    tidy = tx.collapse(text) if tidy is None else tidy
    return normalize_quantity(_first_match(QUANTITY_PATTERNS, QUANTITY_NEEDS, tidy, folded))


def mrp(text: Column, tidy: Column | None = None, folded: Column | None = None) -> Column:
    return _first_match(MRP_PATTERNS, MRP_NEEDS, tx.collapse(text) if tidy is None else tidy, folded)


def mrp_declared(text: Column, folded: Column | None = None) -> Column:
    return _matches_any(MRP_WORDING, MRP_WORDING_NEEDS, text, folded)


def mrp_tax(text: Column, folded: Column | None = None) -> Column:
    return _matches_any(TAX_WORDING, TAX_NEEDS, text, folded)


def date_field(text: Column, labels: tuple[str, ...], folded: Column | None = None) -> Column:
    first, words = DATE_NEEDS.get(labels, ("", ()))
    pattern = (
        rf"(?:{'|'.join(labels)})\s*[:.\-]?\s*("
        r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{2,4}|"
        r"\d+\s*(?:days?|months?|years?)(?:\s+from\s+(?:mfd|manufacturing|packing))?)"
    )
    return _first_match([_at(first, pattern)], (words,), text, folded)


def consumer_care(text: Column) -> Column:
    """First e-mail and first Indian mobile number."""
    email = F.when(F.contains(text, F.lit("@")), tx.extract(text, EMAIL, 0))
    mobile = tx.extract(text, MOBILE, 0)
    return F.when(email.isNull(), mobile).otherwise(F.concat_ws(", ", email, mobile))


def generic_name(text: Column, lower: Column | None = None, folded: Column | None = None) -> Column:
    """``lower`` is the text in lower case, if it is there already."""
    lower = F.lower(text) if lower is None else lower
    keyword = F.lit(None).cast("string")
    for word, name in reversed(GENERIC_KEYWORDS):
        keyword = F.when(lower.contains(word), name).otherwise(keyword)
    return F.coalesce(_first_match(GENERIC_WORDING, GENERIC_NEEDS, text, folded), keyword)


def classify(text: Column, lower: Column | None = None) -> Column:
    """Struct of category and specific product; the first category with a hit wins."""
    has_any = tx.contains_any if lower is None else _has_any
    lower = F.lower(text) if lower is None else lower
    nothing = F.lit(None).cast("string")
    result = F.struct(F.lit("general").alias("type"), nothing.alias("specific"))
    for category, words in reversed(CATEGORY_KEYWORDS):
        specific = nothing
        for word, product in reversed(SPECIFIC_KEYWORDS[category]):
            specific = F.when(lower.contains(word), product).otherwise(specific)
        found = F.struct(F.lit(category).alias("type"), specific.alias("specific"))
        result = F.when(has_any(lower, words), found).otherwise(result)
    return result


def looks_like_name(text: Column, confidence: Column, lower: Column | None = None) -> Column:
    """Line that may be a product name: clear, short, no regulatory or unit wording. ``lower`` is the text in lower
    case, if it is there already."""
    has_any = tx.contains_any if lower is None else _has_any
    lower = F.lower(text) if lower is None else lower
    return (
        (confidence >= 0.80)
        & F.length(text).between(3, 80)
        & ~F.coalesce(has_any(lower, NAME_STOP_WORDS), F.lit(False))
        & ~text.rlike(r"(?U)^[\d\s./:%₹,\-]+$")
        & ~lower.rlike(r"(?U)(?=[rimkgl])\b(?:rs|inr|mrp|ml|kg|g|mg|litre|liter|l)\b")
    )


def best_name(text: Column, lower: Column | None = None) -> Column:
    """Aggregate: the clearest name-like line of the collapsed ones, the first one among equals."""
    rank = F.struct(F.col("confidence"), -F.col("line_no"))
    return F.max_by(text, F.when(looks_like_name(text, F.col("confidence"), lower), rank))


def _tidied(lines: DataFrame) -> DataFrame:
    """The lines with their collapsed text, and that in lower case, made once a line."""
    return lines.withColumn("_tidy", tx.collapse(F.col("text"))).withColumn("_low", F.lower("_tidy"))


def product_name(lines: DataFrame) -> DataFrame:
    return _tidied(lines).groupBy("product_id", "view").agg(
        best_name(F.col("_tidy"), F.col("_low")).alias("product_name"))


def brand(text: Column, folded: Column | None = None) -> Column:
    """First known brand that stands as a whole word, capitalised.

    A plain search in the folded text goes first: word boundaries are slow to test in every place.
    """
    folded = tx.folded(text) if folded is None else folded
    hit = F.lit(None).cast("string")
    for name in reversed(BRANDS):
        whole = F.contains(folded, F.lit(name)) & text.rlike(rf"{FLAGS}\b{name}\b")
        hit = F.when(whole, name.title()).otherwise(hit)
    return hit


def unit_price(text: Column, folded: Column | None = None) -> Column:
    return tx.collapse_found(F.coalesce(*[
        _sought(folded, n, tx.extract(text, p, 0)) for p, n in zip(UNIT_PRICE_PATTERNS, UNIT_PRICE_NEEDS)]))


def manufacturer(text: Column, folded: Column | None = None) -> Column:
    return _first_match(MAKER_PATTERNS, MAKER_NEEDS, text, folded)


def shelf_life(text: Column, best_before: Column, use_by: Column, folded: Column | None = None) -> Column:
    said = text.rlike(SHELF_LIFE_WORDING)
    if folded is not None:
        said = _has_any(folded, SHELF_LIFE_NEEDS) & said
    return best_before.isNotNull() | use_by.isNotNull() | said


def country(text: Column, folded: Column | None = None) -> Column:
    return _first_match(ORIGIN_PATTERNS, ORIGIN_NEEDS, text, folded)


def imported(country: Column) -> Column:
    """Everything but India is imported."""
    return F.coalesce(~F.lower(country).isin("india", "ind"), F.lit(False))


def origin(text: Column) -> Column:
    """Struct of country and imported flag."""
    found = country(text)
    return F.struct(found.alias("country"), imported(found).alias("imported"))


def fields_of_text(df: DataFrame, text: str, name: str | None = None) -> DataFrame:
    """Add the declaration fields found in one text column."""
    t = F.col(text)
    # What feeds several columns is computed once, in a step before them: other forms of the text, category, origin.
    forms = df.withColumns({"_tidy": tx.collapse(t), "_lower": F.lower(t)})
    forms = forms.withColumn("_folded", tx.folded(t, F.col("_lower")))
    tidy, lower, folded = F.col("_tidy"), F.col("_lower"), F.col("_folded")
    found = forms.withColumns({
        "_class": classify(t, lower), "_country": country(t, folded),
        "best_before": date_field(t, BEST_BEFORE_LABELS, folded),
        "use_by": date_field(t, USE_BY_LABELS, folded),
    })
    nothing = F.lit(None).cast("string")
    return found.withColumns({
        "brand": brand(t, folded),
        "product_name": F.col(name) if name else nothing,
        "generic_name": generic_name(t, lower, folded),
        "net_quantity": net_quantity(t, tidy, folded),
        "mrp": mrp(t, tidy, folded),
        "mrp_declaration_detected": mrp_declared(t, folded),
        "mrp_inclusive_of_taxes": mrp_tax(t, folded),
        "unit_sale_price": unit_price(t, folded),
        "manufacturer_address": manufacturer(t, folded),
        "packer": nothing,
        "importer": nothing,
        "consumer_care": consumer_care(t),
        "mfg_date": date_field(t, MFG_LABELS, folded),
        "country_of_origin": F.col("_country"),
        "product_type": F.col("_class.type"),
        "specific_product": F.col("_class.specific"),
        "is_food": F.col("_class.type") == "food",
        "is_cosmetic": F.col("_class.type") == "cosmetic",
        "is_electronic": F.col("_class.type") == "electronic",
        "is_imported": imported(F.col("_country")),
        "has_shelf_life": shelf_life(t, F.col("best_before"), F.col("use_by"), folded),
    }).drop("_class", "_country", "_tidy", "_lower", "_folded")


def view_texts(lines: DataFrame) -> DataFrame:
    """One row per view: its text in reading order, its best name line, its line count."""
    parts = F.array_sort(F.collect_list(F.when(
        F.col("text") != "",
        F.struct(F.col("line_no"), F.col("_tidy").alias("text")),
    )))
    return _tidied(lines).groupBy("product_id", "view").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("full_text"),
        best_name(F.col("_tidy"), F.col("_low")).alias("_name"),
        F.count("*").alias("num_lines"),
    )


def extract_fields(lines: DataFrame) -> DataFrame:
    """Clean lines -> one row of declaration fields per view, with one shuffle."""
    found = fields_of_text(view_texts(lines), "full_text", "_name")
    return found.select(
        "product_id", "view", *LABEL_FIELDS, "mrp_declaration_detected", "num_lines"
    )


LEGACY = {
    "mfg_date": ("manufacturing_date", "mfg_or_expiry_date"),
    "use_by": ("expiry_date",),
}


def normalize_fields(df: DataFrame, keep: tuple[str, ...] = ("product_id", "view")) -> DataFrame:
    """Project to the 22 fields; absent columns get defaults, older names fill gaps."""
    out = []
    for name in LABEL_FIELDS:
        value = F.col(name) if name in df.columns else label_field_default(name)
        for old in LEGACY.get(name, ()):
            if old in df.columns:
                value = F.coalesce(value, tx.empty_to_null(F.col(old)))
        out.append(value.cast(label_field_type(name)).alias(name))
    return df.select(*[k for k in keep if k in df.columns], *out)
