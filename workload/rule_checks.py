"""Rule engine queries (re_*) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.operators import compliance as c
from packwise.schemas import VIOLATION_FIELDS
from packwise.sources import rulebook
from packwise.sources.rules import compile_rules, load_rules
from workload.inputs import DUCK_LABELS, label_fields
from workload.registry import query

# ---- SQL twin building blocks: rule facts as VALUES, checks as plain SELECTs ----


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


_BASE = _values(
    (str(i), _q(f), _q(s), _q(label))
    for i, (f, (s, label)) in enumerate(rulebook.BASE_MANDATORY.items())
)
_CAT = _values(
    (_q(r["product_type"]), str(10 + i), _q(f), _q(m["severity"]), _q(m["label"]))
    for r in rulebook.CATEGORIES
    for i, (f, m) in enumerate(r["mandatory"].items())
)
_EXEMPT = _values(
    (_q(r["product_type"]), _q(f)) for r in rulebook.CATEGORIES for f in r.get("exempted", [])
)
_LEGAL = _values((_q(f), _q(a), _q(b)) for f, (a, b) in rulebook.LEGAL_TEXTS.items())
_EXTRA = _values(
    (_q(name), str(i), _q(f), _q(s), _q(label))
    for name, items in rulebook.EXTRA_MANDATORY.items()
    for i, (f, s, label) in enumerate(items)
)
_PRODUCTS = _values((_q(r["product"]),) for r in rulebook.PRODUCTS)

_VALUE_OF = """CASE {f} WHEN 'manufacturer' THEN k.manufacturer WHEN 'generic_name' THEN k.generic_name
 WHEN 'net_quantity' THEN k.net_quantity WHEN 'mrp' THEN k.mrp WHEN 'consumer_care' THEN k.consumer_care
 WHEN 'country_of_origin' THEN k.country_of_origin WHEN 'best_before' THEN k.best_before
 WHEN 'mfg_date' THEN k.mfg_date END"""

DUCK_KEYED = f"""{DUCK_LABELS},
typed AS (SELECT *, lower(trim(coalesce(nullif(product_type, ''), 'general'))) AS t0,
 nullif(lower(trim(specific_product)), '') AS sprod FROM label_fields),
keyed AS (SELECT *, CASE t0 WHEN 'cosmetic' THEN 'cosmetics' WHEN 'electronics' THEN 'electronic'
 WHEN 'garment' THEN 'garments' WHEN 'drug' THEN 'drugs_medical' WHEN 'drugs' THEN 'drugs_medical'
 WHEN 'medical' THEN 'drugs_medical' WHEN 'e-commerce' THEN 'ecommerce' WHEN 'seed' THEN 'seeds'
 WHEN 'multipiece' THEN 'multi_piece' ELSE t0 END AS ptype FROM typed),
base_req(pos, field, severity, label) AS (VALUES {_BASE}),
cat_req(rule_type, pos, field, severity, label) AS (VALUES {_CAT}),
exempt(rule_type, field) AS (VALUES {_EXEMPT}),
legal(field, ref, why) AS (VALUES {_LEGAL}),
extra(product, pos, field, severity, label) AS (VALUES {_EXTRA}),
known_products(product) AS (VALUES {_PRODUCTS}),
ruled AS (SELECT *, CASE WHEN ptype IN (SELECT rule_type FROM cat_req) THEN ptype ELSE 'general' END
 AS rule_type FROM keyed),
overlay AS (
 SELECT t.rule_type, b.pos, b.field, coalesce(cr.severity, b.severity) AS severity,
  coalesce(cr.label, b.label) AS label
 FROM (SELECT DISTINCT rule_type FROM cat_req) t CROSS JOIN base_req b
 LEFT JOIN cat_req cr ON cr.rule_type = t.rule_type AND cr.field = b.field
 UNION ALL
 SELECT rule_type, pos, field, severity, label FROM cat_req
 WHERE field NOT IN (SELECT field FROM base_req)),
required AS (SELECT o.*, l.ref, l.why FROM overlay o LEFT JOIN legal l ON l.field = o.field
 WHERE NOT EXISTS (SELECT 1 FROM exempt x WHERE x.rule_type = o.rule_type AND x.field = o.field))"""

_MONTH = ("(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(tember)?|"
          "oct(ober)?|nov(ember)?|dec(ember)?)")
_ONES = "(one|two|three|four|five|six|seven|eight|nine)"
_LIFE = (
    rf"(?i)(\d+|{_ONES}|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|"
    rf"nineteen|(twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)([\s-]+{_ONES})?)"
    r"\s+(months?|years?|days?)\b.*?\b(mfd|mfg|manufactur(e|ed|ing)|pack(ed|ing)?|import(ed|ing)?)\b"
)


def _bad_date(field: str) -> str:
    v = f"trim({field})"
    tests = (
        rf"(?i)\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b", rf"(?i)\b\d{{1,2}}[/-]\d{{2,4}}\b",
        rf"(?i)\b\d{{1,2}}[-/ ]{_MONTH}[-/ ]\d{{2,4}}\b", rf"(?i)\b{_MONTH}[-/ ]\d{{2,4}}\b", _LIFE,
    )
    hit = " OR ".join(f"regexp_matches({v}, {_q(t)})" for t in tests)
    return f"{v} <> '' AND NOT ({hit})"


def _vio(grp, pos, rule_id, field, message, severity, where, *, suggestion=None, detected="NULL",
         expected="NULL", layer=None, ref=None, why=None, source="ruled", raw=False) -> str:
    lit = (lambda x: x) if raw else _q
    return (
        f"SELECT inspection_id, '{grp}' AS grp, {pos} AS ord, {lit(rule_id)} AS rule_id, "
        f"{lit(field)} AS field, {lit(message)} AS message, {lit(severity)} AS severity, "
        f"{lit(suggestion) if suggestion is not None else 'NULL'} AS suggestion, "
        f"{detected} AS detected_value, {expected} AS expected, {_q(layer)} AS layer, "
        f"{lit(ref) if ref is not None else 'NULL'} AS legal_reference, "
        f"{lit(why) if why is not None else 'NULL'} AS explanation FROM {source} WHERE {where}"
    )


_mrp_norm = "trim(regexp_replace(lower(mrp), '\\s+', ' ', 'g'))"
_qty_norm = "trim(regexp_replace(lower(net_quantity), '\\s+', ' ', 'g'))"
_qty_re = (r"'(\d+[.,]?\d*)\s*(kg|g|gm|gram|grams|ml|l|ltr|litre|liter|cm|m|meter|metre|nos|no|"
           r"number|pcs|pieces?)'")
_min_font = ("CASE WHEN pdp_area_cm2 < 50 THEN '1.0' WHEN pdp_area_cm2 < 100 THEN '1.5' "
             "WHEN pdp_area_cm2 < 500 THEN '2.5' WHEN pdp_area_cm2 < 2500 THEN '4.0' ELSE '6.0' END")
_ORIGIN_REF, _ORIGIN_WHY = rulebook.LEGAL_TEXTS["country_of_origin"]
_MAKER_REF, _MAKER_WHY = rulebook.LEGAL_TEXTS["manufacturer"]

_DATE_HINT = ("Use a readable date such as 'Jan 2025', '01/2025', 'January 2025', or a valid "
              "shelf-life declaration such as '24 Months From MFD'.")
_pres = f"(SELECT k.*, r.pos, r.field AS rf, r.severity AS rs, r.label, r.ref, r.why, {_VALUE_OF.format(f='r.field')} AS v FROM ruled k JOIN required r ON r.rule_type = k.rule_type)"
_prod = f"(SELECT k.*, r.pos, r.field AS rf, r.severity AS rs, r.label, {_VALUE_OF.format(f='r.field')} AS v FROM ruled k JOIN extra r ON r.product = k.sprod)"
_soft = "(rf = 'mrp' AND coalesce(mrp_declaration_detected, false))"

DUCK_VIOLATIONS = DUCK_KEYED + ", vio AS (" + " UNION ALL ".join([
    _vio("presence", "pos", f"CASE WHEN {_soft} THEN 'MRP_VALUE_VERIFICATION' ELSE 'PRESENCE_' || upper(rf) END", "rf",
         f"CASE WHEN {_soft} THEN 'MRP declaration detected, but the numeric MRP value could not be extracted.' "
         "ELSE 'Missing mandatory declaration: ' || label END",
         f"CASE WHEN {_soft} THEN 'medium' ELSE rs END",
         "coalesce(trim(v), '') = ''",
         suggestion=f"CASE WHEN {_soft} THEN 'Manually verify the numeric MRP value on the product label.' "
         "ELSE 'Ensure ''' || label || ''' is clearly printed on the product label.' END",
         ref="ref", why="why", source=_pres, raw=True),
    _vio("conditional", 50, "PRESENCE_COUNTRY_OF_ORIGIN", "country_of_origin",
         "Missing required declaration: Country of Origin", "high",
         "is_imported AND coalesce(trim(country_of_origin), '') = ''",
         suggestion="This field is mandatory for the given product type or condition."),
    _vio("custom", 60, "IMP_001", "country_of_origin",
         "Country of Origin is mandatory for all imported packages", "high",
         "rule_type = 'imported' AND coalesce(trim(country_of_origin), '') = ''",
         suggestion="Declare clearly as 'Country of Origin: XXX' or 'Made in XXX'", layer="category"),
    _vio("product", "70 + pos", "'PROD_MANDATORY_' || upper(rf)", "rf", "label", "rs",
         "coalesce(trim(v), '') = ''", layer="product", source=_prod, raw=True),
    _vio("mrp", 101, "MRP_001", "mrp", "MRP does not clearly state that it is inclusive of all taxes", "high",
         "mrp <> '' AND NOT mrp_inclusive_of_taxes AND NOT (" + " OR ".join(
             f"contains({_mrp_norm}, '{p}')" for p in (
                 "inclusive of all tax", "incl. of all tax", "incl of all taxes",
                 "including all taxes", "inclusive of taxes")) + ")",
         suggestion="Use format: 'MRP Rs. XX.XX (Inclusive of all taxes)' or 'MRP ₹XX.XX incl. of all taxes'",
         detected="mrp"),
    _vio("mrp", 102, "MRP_002", "mrp", "MRP does not contain currency indicator (Rs. / ₹)", "medium",
         "mrp <> '' AND NOT regexp_matches(lower(mrp), 'rs|₹|inr|rupee')",
         suggestion="Prefix price with Rs. or ₹", detected="mrp"),
    _vio("mrp", 103, "MRP_003", "mrp", "Could not detect a valid numeric price in MRP declaration", "high",
         "mrp <> '' AND NOT regexp_matches(mrp, '[0-9]')", detected="mrp"),
    _vio("qty", 111, "QTY_001", "net_quantity", "Net quantity is not in standard format (value + unit)", "high",
         f"net_quantity <> '' AND NOT regexp_matches({_qty_norm}, {_qty_re})",
         suggestion="Use standard units: g, kg, ml, L, m, cm, nos etc. Example: '200 g' or '500 ml'",
         detected="net_quantity"),
    _vio("qty", 112, "QTY_002", "net_quantity", "Net quantity value must be positive", "high",
         f"net_quantity <> '' AND TRY_CAST(replace(regexp_extract({_qty_norm}, {_qty_re}, 1), ',', '.') AS DOUBLE) <= 0",
         detected="net_quantity"),
    *[_vio("date", 120 + i, f"DATE_{f.upper()}", f,
           f"{label} does not appear to be in a readable date or shelf-life format", "medium",
           _bad_date(f), suggestion=_DATE_HINT, detected=f"trim({f})")
      for i, (f, label) in enumerate((
          ("mfg_date", "Manufacture / Packing / Import date"),
          ("best_before", "Best Before date"), ("use_by", "Use By date")))],
    _vio("care", 131, "CARE_001", "consumer_care", "Consumer care details must include a valid email address", "high",
         "consumer_care <> '' AND NOT regexp_matches(consumer_care, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')",
         suggestion="Email is mandatory under the Rules", detected="consumer_care"),
    _vio("care", 132, "CARE_002", "consumer_care",
         "Consumer care details should include a contact phone / toll-free number", "medium",
         "consumer_care <> '' AND length(regexp_replace(consumer_care, '[^0-9]', '', 'g')) < 10",
         detected="consumer_care"),
    _vio("usp", 141, "USP_001", "unit_sale_price",
         "Unit Sale Price does not follow the required format (e.g. Rs. X.XX per g / per kg / per ml)", "medium",
         "unit_sale_price <> '' AND NOT is_multi_piece AND NOT regexp_matches("
         "regexp_replace(lower(unit_sale_price), '\\s+', ' ', 'g'), "
         "'per (g|kg|ml|l|cm|m|nos|number|unit)|/(g|kg|ml|l)')",
         suggestion="Declare as 'Rs. 0.25 per g' or '₹12.50 per kg' etc. Round to 2 decimal places.",
         detected="unit_sale_price"),
    _vio("origin", 151, "COO_001", "country_of_origin", "Country of Origin is mandatory for imported products", "high",
         "is_imported AND coalesce(trim(country_of_origin), '') = ''",
         suggestion="Declare as 'Country of Origin: XXX' or 'Made in XXX'", ref=_ORIGIN_REF, why=_ORIGIN_WHY),
    _vio("mfr", 161, "MFR_001", "manufacturer",
         "Manufacturer / Packer / Importer name & address appears incomplete", "medium",
         "trim(manufacturer) <> '' AND length(trim(manufacturer)) < 10",
         suggestion="Must include name and complete address", detected="manufacturer", ref=_MAKER_REF,
         why=_MAKER_WHY + " The extracted declaration appears incomplete."),
    _vio("font", 171, "'FONT_001'", "'font_size'",
         "'Font height (' || format('{:.1f}', estimated_font_height_mm) || ' mm) is below the minimum required (' || "
         f"{_min_font} || ' mm) for PDP area of ' || format('{{:.0f}}', pdp_area_cm2) || ' cm²'", "'high'",
         f"pdp_area_cm2 IS NOT NULL AND estimated_font_height_mm < CAST({_min_font} AS DOUBLE)",
         suggestion=f"'Increase font size of mandatory declarations to at least ' || {_min_font} || ' mm'",
         detected="format('{:.1f}', estimated_font_height_mm) || ' mm'",
         expected=f"'>= ' || {_min_font} || ' mm'", raw=True),
]) + ")"

# The checks with no custom conditions: every label column the result needs.
DUCK_RESULT = DUCK_VIOLATIONS + """,
tally AS (SELECT inspection_id,
 sum(CASE severity WHEN 'high' THEN 15 WHEN 'medium' THEN CASE WHEN layer = 'product' THEN 4 ELSE 8 END
     WHEN 'low' THEN CASE WHEN layer = 'product' THEN 2 ELSE 3 END ELSE 0 END) AS points,
 count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
 count(*) FILTER (severity = 'low') AS low, count(*) AS n,
 string_agg(rule_id, ',' ORDER BY ord) AS rule_ids,
 string_agg(DISTINCT CASE WHEN rule_id LIKE 'PRESENCE~_%' ESCAPE '~' THEN field END, ',' ORDER BY
   CASE WHEN rule_id LIKE 'PRESENCE~_%' ESCAPE '~' THEN field END) AS missing
 FROM vio GROUP BY inspection_id),
scored AS (SELECT k.*, CAST(greatest(0, 100 - coalesce(t.points, 0)) AS DOUBLE) AS score,
 coalesce(t.high, 0) AS high, coalesce(t.medium, 0) AS medium, coalesce(t.low, 0) AS low,
 coalesce(t.n, 0) AS n, coalesce(t.rule_ids, '') AS rule_ids, coalesce(t.missing, '') AS missing
 FROM ruled k LEFT JOIN tally t USING (inspection_id)),
result AS (SELECT *, high = 0 AS is_compliant, mrp_confidence < 0.5 AS needs_manual_review,
 CASE WHEN high = 0 AND score >= 90 THEN 'Package appears COMPLIANT under ' || ptype ||
   coalesce(' (' || sprod || ')', '') || ' rules (Score: ' || format('{:.0f}', score) || '/100).'
  WHEN high = 0 THEN 'Mostly compliant with ' || medium || ' medium and ' || low ||
   ' low issues (Score: ' || format('{:.0f}', score) || '/100). Review recommended.'
  ELSE 'NON-COMPLIANT: ' || high || ' high-severity and ' || medium ||
   ' medium-severity violations found (Score: ' || format('{:.0f}', score) || '/100).' END AS summary,
 'universal,category:' || ptype || CASE WHEN sprod IN (SELECT product FROM known_products)
   THEN ',product:' || sprod ELSE '' END AS layers
 FROM scored)"""

# ---- registered queries ---------------------------------------------------------


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.with_rules(label_fields(spark, sf_dir), load_rules(spark))


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.check(label_fields(spark, sf_dir), load_rules(spark))


def _checked(spark: SparkSession, sf_dir: str, check) -> DataFrame:
    rules = load_rules(spark)
    return _long(c.with_rules(label_fields(spark, sf_dir), rules), check(rules))


def _long(df: DataFrame, violations) -> DataFrame:
    return df.select("inspection_id", F.inline(violations))


_COLS = ", ".join(VIOLATION_FIELDS)

_PER_CHECK = {
    "re_presence": ("presence", c.presence),
    "re_conditional": ("conditional", lambda r: c.conditional()),
    "re_custom_must_exist": ("custom", lambda r: c.custom_checks(r, "category")),
    "re_product_mandatory": ("product", c.product_mandatory),
    "re_mrp_format": ("mrp", lambda r: c.mrp_format()),
    "re_qty_format": ("qty", lambda r: c.qty_format()),
    "re_date_format": ("date", lambda r: c.date_format()),
    "re_care_format": ("care", lambda r: c.care_format()),
    "re_usp_format": ("usp", lambda r: c.usp_format()),
    "re_origin_format": ("origin", lambda r: c.origin_format()),
    "re_mfr_format": ("mfr", lambda r: c.mfr_format()),
    "re_font_size": ("font", lambda r: c.font_size()),
}
for _name, (_grp, _check) in _PER_CHECK.items():
    query(_name, f"WITH {DUCK_VIOLATIONS} SELECT inspection_id, {_COLS} FROM vio WHERE grp = '{_grp}'")(
        lambda spark, sf_dir, check=_check: _checked(spark, sf_dir, check)
    )


@query("re_mrp_verification", f"""WITH {DUCK_VIOLATIONS} SELECT inspection_id, message, severity, suggestion
FROM vio WHERE grp = 'presence' AND rule_id = 'MRP_VALUE_VERIFICATION'""")
def re_mrp_verification(spark, sf_dir):
    return _checked(spark, sf_dir, c.presence).filter(
        "rule_id = 'MRP_VALUE_VERIFICATION'"
    ).select("inspection_id", "message", "severity", "suggestion")


# A rule book of our own, to exercise the conditions the shipped one does not use.
_OWN_CATEGORY = {
    "general": {
        "custom_checks": [
            {"rule_id": "OWN_TAX", "field": "mrp", "expected_contains": "Taxes", "severity": "low",
             "message": "Tax wording expected"},
            {"rule_id": "OWN_UNIT", "field": "net_quantity", "expected_any": [" g", " ml"],
             "severity": "medium", "message": "Metric unit expected"},
            {"rule_id": "OWN_NO_USE_BY", "field": "use_by", "must_not_exist": True,
             "severity": "info", "message": "Use by not wanted"},
            {"rule_id": "OWN_FLAG", "field": "is_multi_piece", "expected_contains": "false",
             "severity": "low", "message": "Single packs only"},
            {"rule_id": "OWN_ADVICE", "field": "mrp", "message": "never fires"},
        ],
    }
}


def _own_sql(rule_id: str, field: str, message: str, severity: str, where: str) -> str:
    return (f"WITH {DUCK_LABELS} SELECT inspection_id, '{rule_id}' AS rule_id, '{field}' AS field, "
            f"'{message}' AS message, '{severity}' AS severity FROM label_fields WHERE {where}")


def _own_checks(spark, sf_dir, rule_ids):
    rules = compile_rules(spark, _OWN_CATEGORY, {})
    found = _long(c.with_rules(label_fields(spark, sf_dir), rules),
                  c.custom_checks(rules, "category"))
    return found.filter(F.col("rule_id").isin(rule_ids)).select(
        "inspection_id", "rule_id", "field", "message", "severity")


@query("re_custom_contains", _own_sql(
    "OWN_TAX", "mrp", "Tax wording expected", "low",
    "NOT contains(coalesce(lower(mrp), ''), 'taxes')")
    + " UNION ALL SELECT inspection_id, 'OWN_FLAG', 'is_multi_piece', 'Single packs only', 'low' "
    "FROM label_fields WHERE is_multi_piece")
def re_custom_contains(spark, sf_dir):
    return _own_checks(spark, sf_dir, ["OWN_TAX", "OWN_FLAG"])


@query("re_custom_any", _own_sql(
    "OWN_UNIT", "net_quantity", "Metric unit expected", "medium",
    "NOT regexp_matches(coalesce(lower(trim(net_quantity)), ''), 'g|ml')"))
def re_custom_any(spark, sf_dir):
    return _own_checks(spark, sf_dir, ["OWN_UNIT"])


@query("re_custom_must_not_exist", _own_sql(
    "OWN_NO_USE_BY", "use_by", "Use by not wanted", "info", "coalesce(trim(use_by), '') <> ''"))
def re_custom_must_not_exist(spark, sf_dir):
    return _own_checks(spark, sf_dir, ["OWN_NO_USE_BY"])


@query("re_custom_advisory", f"""WITH {DUCK_LABELS} SELECT rule_id, count(*) AS fired FROM (
 SELECT 'OWN_TAX' AS rule_id FROM label_fields WHERE NOT contains(coalesce(lower(mrp), ''), 'taxes')
 UNION ALL SELECT 'OWN_FLAG' FROM label_fields WHERE is_multi_piece
 UNION ALL SELECT 'OWN_UNIT' FROM label_fields
  WHERE NOT regexp_matches(coalesce(lower(net_quantity), ''), 'g|ml')
 UNION ALL SELECT 'OWN_NO_USE_BY' FROM label_fields WHERE trim(use_by) <> '') GROUP BY rule_id""")
def re_custom_advisory(spark, sf_dir):
    """Which conditions of the rule book fire: advice never does."""
    rules = compile_rules(spark, _OWN_CATEGORY, {})
    found = _long(c.with_rules(label_fields(spark, sf_dir), rules),
                  c.custom_checks(rules, "category"))
    return found.groupBy("rule_id").agg(F.count("*").alias("fired"))


@query("re_type_alias", f"""WITH {DUCK_KEYED} SELECT inspection_id, ptype AS product_type,
 sprod AS specific_product FROM keyed""")
def re_type_alias(spark, sf_dir):
    return c.with_keys(label_fields(spark, sf_dir)).select(
        "inspection_id", "product_type", "specific_product")


@query("re_category_lookup", f"""WITH {DUCK_KEYED} SELECT inspection_id, ptype AS product_type, rule_type
FROM ruled""")
def re_category_lookup(spark, sf_dir):
    df = c.join_category(c.with_keys(label_fields(spark, sf_dir)), load_rules(spark))
    return df.select("inspection_id", "product_type", "rule_type")


@query("re_product_lookup", f"""WITH {DUCK_KEYED} SELECT inspection_id, sprod AS specific_product,
 sprod IS NOT NULL AND sprod IN (SELECT product FROM known_products) AS has_product_rules,
 coalesce((SELECT count(*) FROM extra x WHERE x.product = k.sprod), 0) AS extra_fields FROM keyed k""")
def re_product_lookup(spark, sf_dir):
    df = c.join_product(c.with_keys(label_fields(spark, sf_dir)), load_rules(spark))
    extra = F.coalesce(F.size("extra_mandatory"), F.lit(0)).cast("bigint")
    return df.select("inspection_id", "specific_product", "has_product_rules",
                     F.when(F.col("has_product_rules"), extra).otherwise(F.lit(0)).alias("extra_fields"))


@query("re_effective_rules", f"""WITH {DUCK_KEYED} SELECT inspection_id, coalesce((SELECT
 string_agg(field, ',' ORDER BY field) FROM (SELECT field FROM exempt x WHERE x.rule_type = k.rule_type
  UNION SELECT 'consumer_care' WHERE k.sprod = 'milk')), '') AS exempted FROM ruled k""")
def re_effective_rules(spark, sf_dir):
    """Category exemptions joined with a product's own (milk drops consumer care here)."""
    categories = {r["product_type"]: r for r in rulebook.CATEGORIES}
    rules = compile_rules(spark, categories, {"milk": {"exempted": ["consumer_care"]}})
    df = c.with_rules(label_fields(spark, sf_dir), rules)
    return df.select("inspection_id", F.array_join(F.array_sort(c.effective_exempt()), ",").alias("exempted"))


@query("re_required_set", f"""WITH {DUCK_KEYED} SELECT inspection_id, string_agg(
 r.field || ':' || r.severity || ':' || r.label, '|' ORDER BY r.pos) AS required
FROM ruled k JOIN required r ON r.rule_type = k.rule_type GROUP BY inspection_id""")
def re_required_set(spark, sf_dir):
    line = F.transform(c.effective_required(), lambda r: F.concat_ws(":", r["field"], r["severity"], r["label"]))
    return _ruled(spark, sf_dir).select("inspection_id", F.array_join(line, "|").alias("required"))


@query("re_violations", f"""WITH {DUCK_VIOLATIONS} SELECT inspection_id,
 row_number() OVER (PARTITION BY inspection_id ORDER BY ord) - 1 AS pos, {_COLS} FROM vio""")
def re_violations(spark, sf_dir):
    df = c.with_violations(label_fields(spark, sf_dir), load_rules(spark))
    return df.select("inspection_id", F.posexplode("violations").alias("pos", "v")).select(
        "inspection_id", F.col("pos").cast("bigint").alias("pos"), "v.*")


def _result_query(name: str, sql_columns: str, build):
    @query(name, f"WITH {DUCK_RESULT} SELECT inspection_id, {sql_columns} FROM result")
    def run(spark, sf_dir):
        return scored_labels(spark, sf_dir).select("inspection_id", *build())
    return run


_result_query("re_review_flag", "needs_manual_review", lambda: ["needs_manual_review"])
_result_query("re_score", "score", lambda: ["score"])
_result_query("re_status", "is_compliant", lambda: ["is_compliant"])
_result_query("re_missing", "missing AS missing_fields",
              lambda: [F.array_join("missing_fields", ",").alias("missing_fields")])
_result_query("re_counts", "high, medium, low", lambda: [
    F.col(f"severity_counts.{s}").cast("bigint").alias(s) for s in ("high", "medium", "low")])
_result_query("re_summary", "summary", lambda: ["summary"])
_result_query("re_layers", "layers AS layers_applied",
              lambda: [F.array_join("layers_applied", ",").alias("layers_applied")])
_result_query(
    "re_check",
    "is_compliant, score, ptype AS product_type, sprod AS specific_product, n AS n_violations, rule_ids, "
    "missing AS missing_fields, needs_manual_review, summary, 'LMPC_3Layer_2024' AS rule_version, "
    "layers AS layers_applied",
    lambda: [
        "is_compliant", "score", "product_type", "specific_product",
        F.size("violations").cast("bigint").alias("n_violations"),
        F.array_join(F.transform("violations", lambda v: v["rule_id"]), ",").alias("rule_ids"),
        F.array_join("missing_fields", ",").alias("missing_fields"),
        "needs_manual_review", "summary", "rule_version",
        F.array_join("layers_applied", ",").alias("layers_applied"),
    ],
)


#: Fields of which the labels here repeat a few values.
REPEATED = ("mrp", "net_quantity", "mfg_date", "best_before", "use_by", "unit_sale_price")


@query("re_check_by_value", f"""WITH {DUCK_RESULT} SELECT inspection_id, is_compliant, score, n AS n_violations, rule_ids FROM result""")
def re_check_by_value(spark, sf_dir):
    """The whole score, with the patterns run once for each different value of some fields."""
    return c.check(label_fields(spark, sf_dir), load_rules(spark), REPEATED).select(
        "inspection_id", "is_compliant", "score", F.size("violations").cast("bigint").alias("n_violations"),
        F.array_join(F.transform("violations", lambda v: v["rule_id"]), ",").alias("rule_ids"))


@query("src_rules", f"""WITH {DUCK_KEYED} SELECT rule_type, count(*) AS labels,
 max((SELECT count(*) FROM required o WHERE o.rule_type = k.rule_type)) AS required_fields,
 max((SELECT count(*) FROM exempt x WHERE x.rule_type = k.rule_type)) AS exempted_fields,
 count(*) FILTER (sprod IN (SELECT product FROM known_products)) AS with_product_rules
FROM ruled k GROUP BY rule_type""")
def src_rules(spark, sf_dir):
    """Labels governed by each loaded category rule, with the size of the rule."""
    rules = load_rules(spark)
    df = c.join_product(c.join_category(c.with_keys(label_fields(spark, sf_dir)), rules), rules)
    return df.groupBy("rule_type").agg(
        F.count("*").alias("labels"),
        F.max(F.size("required")).cast("bigint").alias("required_fields"),
        F.max(F.size("cat_exempted")).cast("bigint").alias("exempted_fields"),
        F.count_if("has_product_rules").alias("with_product_rules"),
    )
