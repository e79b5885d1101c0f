"""Extraction (ex_*) and mapping (mp_*) queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.operators import extraction as ex
from packwise.operators import mapping as mp
from packwise.operators import replies as rp

from workload.inputs import (
    DUCK_LABELS, DUCK_LINES, DUCK_TEXT, DUCK_VIEWS, label_fields, label_text, ocr_lines,
    view_fields,
)
from workload.registry import query

T = f"WITH {DUCK_TEXT} "


def _rx(*patterns: str, group: int = 1, text: str = "raw_text") -> str:
    return "coalesce(" + ", ".join(
        f"nullif(regexp_extract({text}, '(?i){p}', {group}), '')" for p in patterns) + ")"


_UNIT = "(?:kg|kgs|kilograms?|g|gm|gms|grams?|ml|millilitres?|milliliters?|l|ltr|litres?|liters?"
_N = r"\d+(?:\.\d+)?\s*"
_QTY = _rx(
    rf"\b(?:NET\s*(?:QUANTITY|QTY|CONTENT|CONTENTS|WT\.?|WEIGHT|VOL\.?|VOLUME)|QUANTITY|QTY)\b\s*[:\-]?\s*({_N}{_UNIT}|cm|m|nos|no\.?|pieces?|pcs|units?|u|n))\b",
    rf"\bNET\b\s*[:\-]?\s*({_N}{_UNIT}|nos|pieces?|pcs|units?))\b",
    rf"\b({_N}(?:kg|kgs|kilograms?|gm|gms|grams?|millilitres?|milliliters?|litres?|liters?))\b",
    rf"\b({_N}(?:g|kg|ml|l))\b",
)
_P = r"(\d{1,6}(?:\.\d{1,2})?)\b"
_C = r"(?:₹|rs\.?|inr)"
_MRP = _rx(
    rf"\bM\s*\.?\s*R\s*\.?\s*P\s*\.?\s*[:\-]?\s*{_C}?\s*{_P}", rf"\bM\s+R\s+P\b\s*[:\-]?\s*{_C}?\s*{_P}",
    rf"\bMAX(?:IMUM)?\s+RETAIL\s+PRICE\b\s*[:\-]?\s*{_C}?\s*{_P}", rf"\bMRP\b.{{0,20}}?{_C}\s*{_P}",
)
_DATE = (r"\s*[:.\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{2,4}|\d+\s*(?:days?|months?|years?)"
         r"(?:\s+from\s+(?:mfd|manufacturing|packing))?)")
_MFG = _rx(r"(?:mfd|mfg|manufactured\s+on|date\s+of\s+manufacture|pkd|packed\s+on|date\s+of\s+packing)" + _DATE)
_BB = _rx(r"(?:best\s+before|best\s+before\s+end|\bb\.?\s*b\.?\b)" + _DATE)
_USE = _rx(r"(?:use\s+by|expiry|expiry\s+date|exp)" + _DATE)
_CARE = (r"nullif(concat_ws(', ', nullif(regexp_extract(raw_text, '(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b'), ''), "
         r"nullif(regexp_extract(raw_text, '(?:\+91[\s\-]?)?[6-9]\d{9}\b'), '')), '')")
_low = "lower(raw_text)"
_FOOD = f"regexp_matches({_low}, 'juice|biscuits|cookies|honey|milk|tea|coffee|namkeen|snack|food|flour|atta|rice|spice|masala|oil|beverage|drink')"
_COSM = f"regexp_matches({_low}, 'shampoo|toothpaste|soap|face wash|cream|lotion|moisturizer|cosmetic')"
_ELEC = f"regexp_matches({_low}, 'charger|adapter|earphone|headphone|speaker|battery|electronic|power bank')"


def _case(pairs, text=_low) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{v}'" for w, v in pairs) + " END"


_TYPE = f"CASE WHEN {_FOOD} THEN 'food' WHEN {_COSM} THEN 'cosmetic' WHEN {_ELEC} THEN 'electronic' ELSE 'general' END"
_SPEC = (
    f"CASE {_TYPE} WHEN 'food' THEN "
    + _case([("juice", "fruit_juices"), ("biscuit", "biscuits"), ("cookie", "biscuits"), ("honey", "honey"),
             ("tea", "tea"), ("coffee", "coffee"), ("oil", "edible_oil")])
    + " WHEN 'cosmetic' THEN " + _case([("shampoo", "shampoo"), ("toothpaste", "toothpaste"), ("soap", "soap")])
    + " WHEN 'electronic' THEN " + _case([("charger", "charger"), ("adapter", "adapter"), ("battery", "battery")])
    + " END")
_GENERIC = "coalesce(" + _rx(r"(?:product\s+name|generic\s+name)\s*[:\-]\s*([A-Za-z][A-Za-z\s]+)") + ", " + _case([
    ("juice", "Fruit Juice"), ("biscuits", "Biscuits"), ("cookies", "Cookies"), ("honey", "Honey"),
    ("shampoo", "Shampoo"), ("toothpaste", "Toothpaste"), ("soap", "Soap"), ("detergent", "Detergent"),
    ("edible oil", "Edible Oil"), ("cooking oil", "Cooking Oil"), ("spices", "Spices"), ("tea", "Tea"),
    ("coffee", "Coffee"), ("milk", "Milk"), ("namkeen", "Namkeen"), ("snack", "Snack")]) + ")"
_TAX = (r"regexp_matches(raw_text, '(?i)inclusive\s+of\s+all\s+taxes|incl\.?\s+of\s+all\s+taxes|incl\.?\s+all\s+taxes|"
        r"including\s+all\s+taxes|taxes\s+included')")
_DECL = r"regexp_matches(raw_text, '(?i)\bM\s*\.?\s*R\s*\.?\s*P\s*\.?|\bMAX(IMUM)?\s+RETAIL\s+PRICE\b')"
_USP = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(raw_text, '(?i){p}', 0), '')" for p in (
        r"(?:unit\s+(?:sale\s+)?price)\s*[:\-]?\s*(₹|rs\.?|inr)?\s*(\d+(?:\.\d+)?)\s*(?:/|per)\s*(kg|g|l|ml)\b",
        r"(₹|rs\.?|inr)\s*(\d+(?:\.\d+)?)\s*/\s*(kg|g|l|ml)\b")) + ")"
_COUNTRY = "trim(regexp_replace(" + _rx(
    r"(?:country\s+of\s+origin|made\s+in|origin)\s*[:\-]?\s*([A-Za-z ]+)") + r", '\s+', ' ', 'g'))"
_IMPORTED = f"coalesce(lower({_COUNTRY}) NOT IN ('india', 'ind'), false)"
_LIFE = rf"({_BB} IS NOT NULL OR {_USE} IS NOT NULL OR regexp_matches(raw_text, '(?i)\b(shelf\s+life|valid\s+for)\b'))"

def _t():
    return F.col("raw_text")


def _text_query(name: str, sql: str, *columns):
    @query(name, T + f"SELECT inspection_id, {sql} FROM label_text")
    def run(spark, sf_dir):
        return label_text(spark, sf_dir).select("inspection_id", *[c() for c in columns])
    return run


def _upper_units(spark, sf_dir):
    """Quantities spelled with unit words."""
    spelled = F.regexp_replace(F.regexp_replace(
        "net_quantity", " ml$", " Millilitres"), " g$", "grams")
    return label_fields(spark, sf_dir).select(
        "inspection_id", ex.normalize_quantity(spelled).alias("net_quantity"))


query("ex_quantity_norm", f"""WITH {DUCK_LABELS} SELECT inspection_id, net_quantity FROM label_fields""")(_upper_units)

_text_query("ex_first_match", _rx(r"care(\d+)@", r"helpline\s+(\d+)", r"(help)@") + " AS found",
            lambda: tx.first_match([r"(?iU)care(\d+)@", r"(?iU)helpline\s+(\d+)", r"(?iU)(help)@"], _t()).alias("found"))
_text_query("ex_quantity", f"{_QTY} AS net_quantity", lambda: ex.net_quantity(_t()).alias("net_quantity"))
_text_query("ex_mrp", f"{_MRP} AS mrp", lambda: ex.mrp(_t()).alias("mrp"))
_text_query("ex_mrp_declared", f"{_DECL} AS declared", lambda: ex.mrp_declared(_t()).alias("declared"))
_text_query("ex_mrp_tax", f"{_TAX} AS inclusive", lambda: ex.mrp_tax(_t()).alias("inclusive"))
_text_query("ex_date_field", f"{_MFG} AS mfg_date, {_BB} AS best_before, {_USE} AS use_by",
            lambda: ex.date_field(_t(), ex.MFG_LABELS).alias("mfg_date"),
            lambda: ex.date_field(_t(), ex.BEST_BEFORE_LABELS).alias("best_before"),
            lambda: ex.date_field(_t(), ex.USE_BY_LABELS).alias("use_by"))
_text_query("ex_care", f"{_CARE} AS consumer_care", lambda: ex.consumer_care(_t()).alias("consumer_care"))
_text_query("ex_generic", f"{_GENERIC} AS generic_name", lambda: ex.generic_name(_t()).alias("generic_name"))
_text_query("ex_classify", f"{_TYPE} AS product_type, {_SPEC} AS specific_product",
            lambda: ex.classify(_t())["type"].alias("product_type"),
            lambda: ex.classify(_t())["specific"].alias("specific_product"))
_text_query("ex_unit_price", f"{_USP} AS unit_sale_price", lambda: ex.unit_price(_t()).alias("unit_sale_price"))
# The text always has the wording, so splitting on it is the same as the pattern.
_text_query("ex_manufacturer", r"""nullif(trim(regexp_replace(split_part(raw_text, 'Manufactured by:', 2),
 '(?i)\b(consumer|customer|fssai|lic|email|helpline)\b.*$', '')), '') AS manufacturer_address""",
            lambda: ex.manufacturer(_t()).alias("manufacturer_address"))
_text_query("ex_shelf_life", f"{_LIFE} AS has_shelf_life", lambda: ex.shelf_life(
    _t(), ex.date_field(_t(), ex.BEST_BEFORE_LABELS), ex.date_field(_t(), ex.USE_BY_LABELS)).alias("has_shelf_life"))
_text_query("ex_origin", f"{_COUNTRY} AS country, {_IMPORTED} AS imported",
            lambda: ex.origin(_t())["country"].alias("country"), lambda: ex.origin(_t())["imported"].alias("imported"))


@query("ex_brand", f"""WITH {DUCK_TEXT} SELECT inspection_id, CASE WHEN inspection_id % 5 = 0 THEN 'Clinic Plus'
 WHEN inspection_id % 5 = 1 THEN 'Amul' WHEN inspection_id % 5 = 2 THEN 'Real' END AS brand FROM label_text""")
def ex_brand(spark, sf_dir):
    """Whole-word brands only: surreal and amulet are not brands."""
    kind = F.col("inspection_id") % 5
    printed = (
        F.when(kind == 0, F.concat(F.lit("CLINIC PLUS real "), F.substring("raw_text", 5, 1 << 30)))
        .when(kind == 1, _t()).when(kind == 2, F.concat(F.lit("Real "), F.substring("raw_text", 5, 1 << 30)))
        .otherwise(F.concat(F.lit("Surreal amulet"), F.substring("raw_text", 5, 1 << 30)))
    )
    return label_text(spark, sf_dir).select("inspection_id", ex.brand(printed).alias("brand"))


@query("ex_product_name", f"""WITH {DUCK_LINES}, c AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t
 FROM ocr_lines WHERE candidate = 'enhanced'),
kept AS (SELECT * FROM c WHERE confidence >= 0.8 AND length(t) BETWEEN 3 AND 80
 AND NOT regexp_matches(lower(t), 'nutrition|ingredients|manufactured|packed by|marketed by|consumer care|customer care|helpline|fssai|lic|mrp|maximum retail|best before|use by|expiry|mfd|mfg|pkd|net quantity|net qty|inclusive of|all taxes|barcode|www\\.|http|@')
 AND NOT regexp_full_match(t, '[\\p{{Nd}}\\s./:%₹,\\-]+')
 AND NOT regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(rs|inr|mrp|ml|kg|g|mg|litre|liter|l)($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')),
best AS (SELECT *, row_number() OVER (PARTITION BY product_id, "view" ORDER BY confidence DESC, line_no) AS rn FROM kept)
SELECT a.product_id, a."view", b.t AS product_name FROM (SELECT DISTINCT product_id, "view" FROM c) a
LEFT JOIN best b ON b.product_id = a.product_id AND b."view" = a."view" AND b.rn = 1""")
def ex_product_name(spark, sf_dir):
    return ex.product_name(ocr_lines(spark, sf_dir).filter("candidate = 'enhanced'"))


def _two_lines(spark, sf_dir):
    """Every label text as a view of two lines: a heading and the text."""
    rows = F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("  Family   pack special").alias("text"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit(1).alias("line_no"), _t().alias("text"), F.lit(0.95).alias("confidence")),
    )
    return label_text(spark, sf_dir).select(
        F.col("inspection_id").alias("product_id"), F.lit("front").alias("view"), F.inline(rows))


_ALL = f"""WITH {DUCK_TEXT}, joined AS (SELECT inspection_id, 'Family pack special ' || trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS raw_text
 FROM label_text) SELECT inspection_id AS product_id, 'front' AS "view",
 'Amul' AS brand, 'Family pack special' AS product_name, {_GENERIC} AS generic_name, {_QTY} AS net_quantity, {_MRP} AS mrp,
 {_TAX} AS mrp_inclusive_of_taxes, {_USP} AS unit_sale_price,
 nullif(trim(regexp_replace(split_part(raw_text, 'Manufactured by:', 2),
 '(?i)\\b(consumer|customer|fssai|lic|email|helpline)\\b.*$', '')), '') AS manufacturer_address,
 CAST(NULL AS VARCHAR) AS packer, CAST(NULL AS VARCHAR) AS importer, {_CARE} AS consumer_care, {_MFG} AS mfg_date,
 {_BB} AS best_before, {_USE} AS use_by, {_COUNTRY} AS country_of_origin, {_TYPE} AS product_type, {_SPEC} AS specific_product,
 {_TYPE} = 'food' AS is_food, {_TYPE} = 'cosmetic' AS is_cosmetic, {_TYPE} = 'electronic' AS is_electronic,
 {_IMPORTED} AS is_imported, {_LIFE} AS has_shelf_life, {_DECL} AS mrp_declaration_detected, CAST(2 AS BIGINT) AS num_lines
FROM joined"""


@query("ex_all", _ALL)
def ex_all(spark, sf_dir):
    return ex.extract_fields(_two_lines(spark, sf_dir))


@query("ex_normalize_fields", f"""WITH {DUCK_LABELS} SELECT inspection_id AS product_id, NULL::VARCHAR AS brand,
 NULL::VARCHAR AS product_name, generic_name, net_quantity, mrp, mrp_inclusive_of_taxes, unit_sale_price,
 NULL::VARCHAR AS manufacturer_address, NULL::VARCHAR AS packer, NULL::VARCHAR AS importer, consumer_care,
 coalesce(best_before, mfg_date) AS mfg_date, best_before, coalesce(use_by, nullif(generic_name, '')) AS use_by,
 country_of_origin, product_type, specific_product, false AS is_food, false AS is_cosmetic, false AS is_electronic,
 is_imported, false AS has_shelf_life FROM label_fields""")
def ex_normalize_fields(spark, sf_dir):
    """Older field names fill a missing manufacturing date and use-by date."""
    df = label_fields(spark, sf_dir).withColumns({
        "product_id": F.col("inspection_id"), "manufacturing_date": F.col("mfg_date"),
        "mfg_date": F.col("best_before"), "expiry_date": F.col("generic_name"),
    })
    return ex.normalize_fields(df, keep=("product_id",))


# ---- replies --------------------------------------------------------------------


def _replies(spark, sf_dir):
    """Model replies: plain, thinking, wrapped in prose, broken, or not an object."""
    kind = F.col("inspection_id") % 7
    body = F.to_json(F.struct(
        F.lit("Amul").alias("brand"), F.col("net_quantity"), F.col("mrp_confidence").alias("mrp"),
        F.col("mrp_inclusive_of_taxes"), F.col("consumer_care"),
    ), {"ignoreNullFields": "false"})
    reply = (
        F.when(kind == 0, F.concat(F.lit("<think>{is it\nmilk?}</THINK>"), body))
        .when(kind == 1, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone.")))
        .when(kind == 2, F.lit("{\"brand\": \"Am"))
        .when(kind == 3, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 4, F.lit("  ")).otherwise(body)
    )
    return label_fields(spark, sf_dir).select("inspection_id", reply.alias("reply"))


_OK = "inspection_id % 7 IN (0, 1, 5, 6)"


@query("ex_llm_parse", f"""WITH {DUCK_LABELS} SELECT inspection_id, CASE WHEN {_OK} THEN 'Amul' END AS brand,
 CASE WHEN {_OK} THEN net_quantity END AS net_quantity, CASE WHEN {_OK} THEN CAST(mrp_confidence AS VARCHAR) END AS mrp,
 CASE WHEN inspection_id % 7 = 4 THEN 'empty content' WHEN {_OK} THEN NULL ELSE 'no JSON object' END AS reason
FROM label_fields""")
def ex_llm_parse(spark, sf_dir):
    good, bad = rp.parse_replies(_replies(spark, sf_dir), "reply")
    parts = [F.try_element_at("parsed", F.lit(n)).alias(n) for n in ("brand", "net_quantity", "mrp")]
    nothing = F.lit(None).cast("string")
    return good.select("inspection_id", *parts, nothing.alias("reason")).unionByName(
        bad.select("inspection_id", *[nothing.alias(n) for n in ("brand", "net_quantity", "mrp")], "reason"))


@query("ex_llm_defaults", f"""WITH {DUCK_LABELS} SELECT inspection_id, 'Amul' AS brand, net_quantity, NULL::VARCHAR AS product_name,
 mrp_inclusive_of_taxes, 'general' AS product_type, false AS is_food, consumer_care FROM label_fields WHERE {_OK}""")
def ex_llm_defaults(spark, sf_dir):
    good, _ = rp.parse_replies(_replies(spark, sf_dir), "reply")
    return rp.fill_defaults(good).select(
        "inspection_id", "brand", "net_quantity", "product_name", "mrp_inclusive_of_taxes",
        "product_type", "is_food", "consumer_care")


def _bare(column: str):
    return F.regexp_extract(column, r"(\d+)", 1)


_MENTION = r"regexp_extract(raw_text, '(?i)\bM\s*\.?\s*R\s*\.?\s*P\b.{0,120}?(\d+(?:\.\d+)?)', %d)"
_BARE = r"regexp_extract(mrp, '(\d+)', 1)"


@query("ex_llm_mrp_norm", f"""WITH {DUCK_TEXT}, x AS (SELECT inspection_id, {_BARE} AS mrp,
 {_MENTION % 0} AS ctx, {_MENTION % 1} AS price
 FROM label_text JOIN label_fields USING (inspection_id))
SELECT inspection_id, CASE WHEN coalesce(mrp, '') = '' OR ctx = '' THEN mrp
 WHEN regexp_matches(ctx, '(?i)incl(usive|\\.)?\\s+of\\s+(all\\s+)?(the\\s+)?taxes') THEN 'MRP ₹' || price || ' (Inclusive of all taxes)'
 WHEN regexp_matches(ctx, '(?i)₹|rs\\.?|inr|rupee') THEN 'MRP ' || regexp_extract(ctx, '(?i)(₹|rs\\.?|inr|rupee)', 1) || ' ' || price
 ELSE 'MRP ' || price END AS mrp FROM x""")
def ex_llm_mrp_norm(spark, sf_dir):
    both = label_text(spark, sf_dir).join(
        label_fields(spark, sf_dir).select("inspection_id", _bare("mrp").alias("mrp")), "inspection_id")
    return both.select("inspection_id", rp.rebuild_mrp(F.col("mrp"), F.col("raw_text")).alias("mrp"))


@query("ex_llm_usp_norm", f"""WITH {DUCK_LABELS} SELECT inspection_id, CASE WHEN inspection_id % 3 = 0 THEN NULL
 WHEN inspection_id % 4 = 0 THEN 'USP' WHEN inspection_id % 5 = 0 THEN '₹2.5 per ml'
 WHEN inspection_id % 5 = 1 THEN 'Rs. 0.25 per g' WHEN inspection_id % 5 = 2 THEN '₹ 3 per L' ELSE '7' END AS unit_sale_price
FROM label_fields""")
def ex_llm_usp_norm(spark, sf_dir):
    """Bare prices meet label wording; a kg price without currency is not rebuilt."""
    key = F.col("inspection_id")
    price = F.when(key % 3 == 0, None).when(key % 4 == 0, "USP").otherwise("7")
    text = (
        F.when(key % 5 == 0, "USP per ml: 2.5").when(key % 5 == 1, "Price Rs. 0.25 per g")
        .when(key % 5 == 2, "Only ₹3/ltr").otherwise("USP per kg: 9 unit sale price 4 per kg")
    )
    return label_fields(spark, sf_dir).select(
        "inspection_id", rp.rebuild_unit_price(price, text).alias("unit_sale_price"))


def _thin():
    """Empty columns for all text fields but the brand."""
    return {f: F.lit(None).cast("string") for f in (
        "product_name", "generic_name", "net_quantity", "mrp", "manufacturer_address", "consumer_care",
        "mfg_date", "best_before", "use_by", "country_of_origin")}


def _first_views(spark, sf_dir):
    """Views whose extraction often came back empty."""
    seq = F.col("product_id") * 3 + F.when(F.col("view") == "front", 0).when(F.col("view") == "back", 1).otherwise(2)
    return view_fields(spark, sf_dir).withColumns(_thin()).withColumns({
        "brand": F.when(F.col("product_id") % 3 == 0, F.col("brand")),
        "extraction_method": F.when(seq % 11 == 0, "rules").otherwise("llm"),
        "has_text": seq % 13 != 0,
    })


_FIRST = f"""{DUCK_VIEWS}, seq AS (SELECT *, product_id * 3 + CASE "view" WHEN 'front' THEN 0 WHEN 'back' THEN 1 ELSE 2 END AS s
 FROM view_fields), first AS (SELECT *, CASE WHEN product_id % 3 = 0 THEN brand END AS b0,
 s % 11 = 0 AS by_rules, s % 13 <> 0 AS has_text FROM seq),
judged AS (SELECT *, NOT by_rules AND has_text AND coalesce(b0, '') <> '' AS ok,
 CASE WHEN product_id % 7 = 0 THEN country_of_origin END AS retry_origin FROM first),
final AS (SELECT *, NOT ok AND has_text AND coalesce(retry_origin, '') <> '' AS recovered FROM judged)"""


@query("ex_usable_llm", f"""WITH {_FIRST} SELECT product_id, "view", ok AS usable FROM final""")
def ex_usable_llm(spark, sf_dir):
    usable = rp.usable(F.col("extraction_method"), F.col("has_text"))
    return _first_views(spark, sf_dir).select("product_id", "view", usable.alias("usable"))


@query("ex_retry_select", f"""WITH {_FIRST}, p AS (SELECT product_id, bool_or(ok OR recovered) AS any_ok FROM final GROUP BY product_id)
SELECT f.product_id, f."view", CASE WHEN recovered THEN 'llm_retry' WHEN by_rules THEN 'rules' ELSE 'llm' END AS extraction_method,
 CASE WHEN recovered THEN NULL ELSE b0 END AS brand, CASE WHEN recovered THEN retry_origin END AS country_of_origin,
 CASE WHEN bool_or(recovered) OVER (PARTITION BY f.product_id) THEN 'LLM extraction was retried successfully for: ' ||
  (SELECT string_agg(g."view", ', ' ORDER BY s) FROM final g WHERE g.product_id = f.product_id AND g.recovered) || '.' END AS warning
FROM final f JOIN p ON p.product_id = f.product_id AND p.any_ok
UNION ALL SELECT product_id, NULL, NULL, NULL, NULL,
 'LLM extraction returned no usable label fields on any view. No compliance score was generated.' FROM p WHERE NOT any_ok""")
def ex_retry_select(spark, sf_dir):
    first = _first_views(spark, sf_dir)
    retry = view_fields(spark, sf_dir).withColumns({**_thin(), "brand": F.lit(None).cast("string")}).drop(
        "country_of_origin").join(
        view_fields(spark, sf_dir).select("product_id", "view", F.when(
            F.col("product_id") % 7 == 0, F.col("country_of_origin")).alias("country_of_origin")),
        ["product_id", "view"])
    kept, failed = rp.apply_retry(first, retry)
    shown = kept.join(rp.retry_warnings(kept), "product_id", "left").select(
        "product_id", "view", "extraction_method", "brand", "country_of_origin", "warning")
    nothing = F.lit(None).cast("string")
    return shown.unionByName(failed.select(
        "product_id", *[nothing.alias(c) for c in ("view", "extraction_method", "brand", "country_of_origin")],
        F.col("reason").alias("warning")))


# ---- mapping --------------------------------------------------------------------


@query("mp_first_value", f"""WITH {DUCK_LABELS} SELECT inspection_id, coalesce(nullif(generic_name, ''), nullif(mrp, ''), best_before) AS value
FROM (SELECT * REPLACE (CASE WHEN inspection_id % 2 = 0 THEN '' ELSE generic_name END AS generic_name) FROM label_fields)""")
def mp_first_value(spark, sf_dir):
    name = F.when(F.col("inspection_id") % 2 == 0, "").otherwise(F.col("generic_name"))
    return label_fields(spark, sf_dir).select(
        "inspection_id", tx.first_value(name, F.col("mrp"), F.col("best_before")).alias("value"))


_WORDS = ("TRUE", " yes ", "1", "y", "False", "no", "0", "N", "maybe", "")


@query("mp_to_bool", f"""WITH {DUCK_LABELS} SELECT inspection_id, CASE WHEN word IS NULL THEN true
 WHEN lower(trim(word)) IN ('false', 'no', '0', 'n', '') THEN false ELSE true END AS flag FROM (SELECT inspection_id,
 CASE inspection_id % 11 {" ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS))} END AS word FROM label_fields)""")
def mp_to_bool(spark, sf_dir):
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("inspection_id") % 11).cast("int"))
    return label_fields(spark, sf_dir).select("inspection_id", tx.to_bool(word, True).alias("flag"))


_ALIAS = """CASE t WHEN 'cosmetic' THEN 'cosmetics' WHEN 'electronics' THEN 'electronic' WHEN 'garment' THEN 'garments'
 WHEN 'drug' THEN 'drugs_medical' WHEN 'drugs' THEN 'drugs_medical' WHEN 'medical' THEN 'drugs_medical'
 WHEN 'e-commerce' THEN 'ecommerce' WHEN 'seed' THEN 'seeds' WHEN 'multipiece' THEN 'multi_piece' ELSE t END"""
_MAPPED_TYPE = f"""CASE WHEN {_ALIAS} <> 'general' THEN {_ALIAS} WHEN is_food THEN 'food' WHEN is_cosmetic THEN 'cosmetics'
 WHEN is_electronic THEN 'electronic' WHEN is_imported THEN 'imported' ELSE 'general' END"""
_FLAGGED = f"""{DUCK_LABELS}, flagged AS (SELECT *, coalesce(nullif(lower(trim(product_type)), ''), 'general') AS t,
 inspection_id % 4 = 0 AS is_food, inspection_id % 5 = 0 AS is_cosmetic, inspection_id % 6 = 0 AS is_electronic FROM label_fields)"""


def _flagged(spark, sf_dir):
    key = F.col("inspection_id")
    return label_fields(spark, sf_dir).withColumns({
        "is_food": key % 4 == 0, "is_cosmetic": key % 5 == 0, "is_electronic": key % 6 == 0})


@query("mp_product_type", f"WITH {_FLAGGED} SELECT inspection_id, {_MAPPED_TYPE} AS product_type FROM flagged")
def mp_product_type(spark, sf_dir):
    return _flagged(spark, sf_dir).select("inspection_id", mp.product_type(
        *[F.col(c) for c in ("product_type", "is_food", "is_cosmetic", "is_electronic", "is_imported")]
    ).alias("product_type"))


@query("mp_shelf_life", f"""WITH {DUCK_LABELS} SELECT inspection_id, best_before IS NOT NULL OR use_by IS NOT NULL
 OR is_multi_piece AS has_shelf_life FROM label_fields""")
def mp_shelf_life(spark, sf_dir):
    return label_fields(spark, sf_dir).select("inspection_id", mp.shelf_life(
        F.col("is_multi_piece"), F.col("best_before"), F.col("use_by")).alias("has_shelf_life"))


@query("mp_confidence_alias", f"""WITH {DUCK_LABELS} SELECT inspection_id, mrp_confidence AS mrp,
 CASE WHEN inspection_id % 3 = 0 THEN 0.9 WHEN inspection_id % 3 = 1 THEN 0.4 END AS manufacturer FROM label_fields""")
def mp_confidence_alias(spark, sf_dir):
    key = F.col("inspection_id") % 3
    both = F.create_map(F.lit("manufacturer"), F.lit(0.9), F.lit("manufacturer_address"), F.lit(0.1))
    address = F.create_map(F.lit("manufacturer_address"), F.lit(0.4))
    extra = F.when(key == 0, both).when(key == 1, address).otherwise(F.create_map().cast("map<string,double>"))
    alias = mp.confidence_alias(F.map_concat(F.col("ocr_confidence"), extra))
    return label_fields(spark, sf_dir).withColumn("c", alias).select("inspection_id", *[
        F.try_element_at("c", F.lit(n)).alias(n) for n in ("mrp", "manufacturer")])


@query("mp_map_fields", f"""WITH {_FLAGGED} SELECT inspection_id, nullif(generic_name, '') AS generic_name, net_quantity, mrp, manufacturer,
 coalesce(best_before, mfg_date) AS mfg_date, best_before, use_by, {_MAPPED_TYPE} AS product_type, specific_product,
 best_before IS NOT NULL OR use_by IS NOT NULL AS has_shelf_life, is_food, is_imported, mrp_declaration_detected FROM flagged""")
def mp_map_fields(spark, sf_dir):
    df = _flagged(spark, sf_dir).withColumns({
        "mfg_or_expiry_date": F.col("mfg_date"), "mfg_date": F.lit(""),
        "manufacturing_date": F.col("best_before"), "manufacturer_address": F.lit(""),
    })
    return mp.map_to_rules(df, keep=("inspection_id",)).select(
        "inspection_id", "generic_name", "net_quantity", "mrp", "manufacturer", "mfg_date", "best_before",
        "use_by", "product_type", "specific_product", "has_shelf_life", "is_food", "is_imported",
        "mrp_declaration_detected")
