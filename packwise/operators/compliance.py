"""Rule checks over one row per label: violations, score, status, summary.

All checks are column expressions over the label row joined with two small
rule tables, so scoring adds no shuffle of the label data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.schemas import RULE_INPUT, VIOLATION, with_rule_input_defaults
from packwise.sources.rulebook import LEGAL_TEXTS
from packwise.sources.rules import RuleSet
from packwise.sources.storage import stored

RULE_VERSION = "LMPC_3Layer_2024"

# Category spellings accepted by the checks.
TYPE_ALIASES = {
    "cosmetic": "cosmetics", "cosmetics": "cosmetics",
    "electronics": "electronic", "electronic": "electronic",
    "garment": "garments", "garments": "garments",
    "drug": "drugs_medical", "drugs": "drugs_medical",
    "drugs_medical": "drugs_medical", "medical": "drugs_medical",
    "e-commerce": "ecommerce", "ecommerce": "ecommerce",
    "seed": "seeds", "seeds": "seeds",
    "multipiece": "multi_piece", "multi_piece": "multi_piece",
}

# Score weights, review threshold and the fields it looks at.
SEVERITY_WEIGHTS = {"high": 15, "medium": 8, "low": 3, "info": 0}
PRODUCT_LAYER_WEIGHTS = {"medium": 4, "low": 2}
REVIEW_THRESHOLD = 0.5
REVIEW_FIELDS = ("mrp", "net_quantity", "manufacturer", "consumer_care")

# Half-open panel area intervals (cm2) and minimum letter height (mm).
FONT_HEIGHTS = ((0, 50, "1.0"), (50, 100, "1.5"), (100, 500, "2.5"), (500, 2500, "4.0"))
FONT_HEIGHT_LARGEST = "6.0"

# Wording the format checks look for.
TAX_PHRASES = (
    "inclusive of all taxes", "incl. of all taxes", "incl of all taxes",
    "inclusive of all tax", "incl. of all tax", "including all taxes",
    "inclusive of taxes",
)
CURRENCY_MARKS = ("rs", "₹", "inr", "rupee")
UNIT_PRICE_PHRASES = (
    "per g", "per kg", "per ml", "per l", "per cm", "per m", "per nos",
    "per number", "per unit", "/g", "/kg", "/ml", "/l",
)
QUANTITY = (
    r"(?U)(\d+[.,]?\d*)\s*"
    r"(kg|g|gm|gram|grams|ml|l|ltr|litre|liter|cm|m|meter|metre|nos|no|number|pcs|pieces?)"
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

ONES = "one|two|three|four|five|six|seven|eight|nine"
TEENS = (
    "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
)
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
SHELF_LIFE = (
    rf"(?dU)(?:\d+|{ONES}|{TEENS}|(?:{TENS})(?:[\s-]+(?:{ONES}))?)\s+"
    r"(?:month|months|year|years|day|days)\b.*?"
    r"\b(?:mfd|mfg|manufactur(?:e|ed|ing)|pack(?:ed|ing)?|import(?:ed|ing)?)\b"
)
MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|"
    "aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
CALENDAR_DATES = (
    r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"(?U)\b\d{1,2}[/-]\d{2,4}\b",
    rf"(?U)\b\d{{1,2}}[-/ ]{MONTH}[-/ ]\d{{2,4}}\b",
    rf"(?U)\b{MONTH}[-/ ]\d{{2,4}}\b",
)
DATE_FIELDS = (
    ("mfg_date", "Manufacture / Packing / Import date"),
    ("best_before", "Best Before date"),
    ("use_by", "Use By date"),
)


class Sql(str):
    """Expression text, as opposed to literal text."""


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def violation(**parts) -> str:
    """Violation struct as expression text; plain strings are literals.

    Written as one text because a plan built of thousands of single column
    calls takes longer to build than to run on small inputs.
    """
    pairs = []
    for field in VIOLATION.fieldNames():
        value = parts.get(field)
        if value is None:
            value = "cast(null as string)"
        elif not isinstance(value, Sql):
            value = quoted(value)
        pairs.append(f"'{field}', {value}")
    return f"named_struct({', '.join(pairs)})"


NO_VIOLATIONS = f"cast(array() as array<{VIOLATION.simpleString()}>)"


def when_violated(condition: Column, found: str) -> Column:
    """One-element array where the condition holds, else empty.

    Arrays are concatenated rather than filtered: lambda functions run
    interpreted, concatenation is compiled.
    """
    return F.when(condition, F.expr(f"array({found})")).otherwise(F.expr(NO_VIOLATIONS))


def _found(*parts: Column) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


# ---- rule lookup -----------------------------------------------------------

def type_alias(product_type: Column) -> Column:
    named = F.coalesce(tx.empty_to_null(product_type), F.lit("general"))
    return tx.lookup(tx.strip(F.lower(named)), TYPE_ALIASES)


def specific_key(specific_product: Column) -> Column:
    return tx.empty_to_null(tx.strip(F.lower(specific_product)))


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "product_type": type_alias(F.col("product_type")),
        "specific_product": specific_key(F.col("specific_product")),
    })


def join_category(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Category rules by type; types without rules use those of ``general``."""
    known = F.col("product_type").isin(*rules.category_names)
    key = F.when(known, F.col("product_type")).otherwise(F.lit("general"))
    return df.withColumn("rule_type", key).join(rules.category_side(), "rule_type", "left")


def join_product(df: DataFrame, rules: RuleSet) -> DataFrame:
    side = rules.product_side().withColumn("has_product_rules", F.lit(True))
    return df.join(
        side, F.col("specific_product") == F.col("rule_product"), "left"
    ).withColumn("has_product_rules", F.coalesce("has_product_rules", F.lit(False)))


def effective_exempt() -> Column:
    empty = F.array().cast("array<string>")
    return F.array_union(
        F.coalesce("cat_exempted", empty), F.coalesce("prod_exempted", empty)
    )


def effective_required() -> Column:
    """Required fields of the category without those the product exempts."""
    return F.filter(
        "required",
        lambda r: ~F.coalesce(F.array_contains("prod_exempted", r["field"]), F.lit(False)),
    )


def with_rules(df: DataFrame, rules: RuleSet, by_value: Sequence[str] = ()) -> DataFrame:
    """Label rows with defaults, keys, joined rules and the values checks read.

    The values come first: rules are wide, and a row that has them is copied as seldom as possible.
    What the format checks look for is found row by row, or once for each different value of the fields
    named in ``by_value`` (see ``with_value_facts``).
    """
    labels = with_rule_input_defaults(df)
    forms = {f"_form_{f}": form(F.col(f)) for f, form in FORMS.items() if f not in by_value}
    prepared = with_keys(with_value_facts(labels, by_value)).withColumns({
        **forms,
        **{f"_date_{f}": tx.strip(F.col(f)) for f, _ in DATE_FIELDS},
        # One column per field, not a struct: struct parts would be computed again in
        # every rule that reads them.
        **{f"_blank_{f}": _is_missing(f, False) for f in rules.fields["required"]},
        **{f"_untrue_{f}": _is_missing(f, True) for f in rules.fields["extra"]},
        **{f"_lower_{f}": _lower_text(f) for f in rules.fields["checks"]},
    })
    return join_product(join_category(prepared, rules), rules).withColumn(
        "rule_type_known", F.col("required").isNotNull())


def _is_missing(field: str, truthy: bool) -> Column:
    """No text; when ``truthy`` is asked for, false and 0 are missing too."""
    kind = RULE_INPUT.get(field, ("none", None))[0]
    value = F.col(field) if kind != "none" else None
    if kind == "string":
        return tx.is_blank(value)
    if kind == "boolean":
        return ~value if truthy else F.lit(False)
    if kind == "double":
        return F.coalesce(value == 0, F.lit(True)) if truthy else value.isNull()
    return F.lit(True)


def _lower_text(field: str) -> Column:
    kind = RULE_INPUT.get(field, ("none", None))[0]
    if kind == "string":
        return F.coalesce(tx.strip(F.lower(F.col(field))), F.lit(""))
    if kind in ("boolean", "double"):
        return F.coalesce(F.col(field).cast("string"), F.lit(""))
    return F.lit("")


def _of_field(prefix: str, field: str, names, default: str) -> str:
    """Pick the prepared value of the field a rule names."""
    cases = " ".join(f"when {quoted(n)} then `{prefix}{n}`" for n in names)
    return f"(case {field} {cases} else {default} end)" if cases else default


def _each(column: str, rules: RuleSet, condition, found) -> Column:
    """Check every entry of a rule list, in order."""
    parts = [NO_VIOLATIONS]
    for n in range(rules.longest[column]):
        rule = f"get({column}, {n})"
        parts.append(
            f"if({rule} is not null and {condition(rule)}, array({found(rule)}), {NO_VIOLATIONS})"
        )
    return F.expr(f"concat({', '.join(parts)})")


# ---- presence and custom rules ----------------------------------------------

def presence(rules: RuleSet) -> Column:
    """One violation per required field without text; priced wording softens MRP."""

    def absent(rule: str) -> str:
        exempt = f"coalesce(array_contains(prod_exempted, {rule}.field), false)"
        return f"not {exempt} and {_of_field('_blank_', rule + '.field', rules.fields['required'], 'true')}"

    def report(rule: str) -> str:
        verify = f"{rule}.field = 'mrp' and mrp_declaration_detected"

        def either(soft: str, hard: str) -> Sql:
            return Sql(f"if({verify}, {quoted(soft)}, {hard})")

        return violation(
            rule_id=either("MRP_VALUE_VERIFICATION", f"concat('PRESENCE_', upper({rule}.field))"),
            field=Sql(f"{rule}.field"),
            message=either(
                "MRP declaration detected, but the numeric MRP value could not be extracted.",
                f"concat('Missing mandatory declaration: ', {rule}.label)",
            ),
            severity=either("medium", f"{rule}.severity"),
            suggestion=either(
                "Manually verify the numeric MRP value on the product label.",
                f"concat('Ensure \\'', {rule}.label, "
                "'\\' is clearly printed on the product label.')",
            ),
            legal_reference=Sql(f"{rule}.legal_reference"),
            explanation=Sql(f"{rule}.explanation"),
        )

    return _each("required", rules, absent, report)


def conditional() -> Column:
    """Imported goods need a country of origin unless exempted."""
    exempt = (
        "coalesce(array_contains(cat_exempted, 'country_of_origin'), false) or "
        "coalesce(array_contains(prod_exempted, 'country_of_origin'), false)"
    )
    needed = F.expr(f"is_imported and rule_type_known and not ({exempt})")
    return when_violated(needed & tx.is_blank(F.col("country_of_origin")), violation(
        rule_id="PRESENCE_COUNTRY_OF_ORIGIN",
        field="country_of_origin",
        message="Missing required declaration: Country of Origin",
        severity="high",
        suggestion="This field is mandatory for the given product type or condition.",
    ))


def custom_checks(rules: RuleSet, layer: str) -> Column:
    """Rule-table checks: field must exist, must not exist, or contain a text."""

    def fails(check: str) -> str:
        value = _of_field("_lower_", f"{check}.field", rules.fields["checks"], "''")
        return (
            f"case {check}.condition when 'must_exist' then {value} = '' "
            f"when 'must_not_exist' then {value} <> '' "
            f"else not exists({check}.expected, e -> contains({value}, e)) end"
        )

    def report(check: str) -> str:
        parts = {
            name: Sql(f"{check}.{name}")
            for name in ("rule_id", "message", "severity", "suggestion",
                         "legal_reference", "explanation")
        }
        field = Sql(f"coalesce(nullif({check}.field, ''), 'general')")
        return violation(field=field, layer=layer, **parts)

    return _each("cat_checks" if layer == "category" else "prod_checks", rules, fails, report)


def product_mandatory(rules: RuleSet) -> Column:
    return _each(
        "extra_mandatory", rules,
        lambda r: _of_field("_untrue_", f"{r}.field", rules.fields["extra"], "true"),
        lambda r: violation(
            rule_id=Sql(f"concat('PROD_MANDATORY_', upper({r}.field))"),
            field=Sql(f"{r}.field"), message=Sql(f"{r}.message"),
            severity=Sql(f"{r}.severity"), suggestion=Sql(f"{r}.suggestion"),
            layer="product",
        ),
    )


# ---- what is found in a value --------------------------------------------------

def quantity_digits(text: Column) -> Column:
    """Number before the first unit, null when no number and unit stand together."""
    return tx.extract(tx.normalize_key(text), QUANTITY, 1)


def _is_positive(digits: Column) -> Column:
    number = tx.ascii_digits(F.translate(digits, ",", ".")).try_cast("double")
    return ~F.coalesce(number <= 0, F.lit(False))


def is_readable_date(text: Column) -> Column:
    return tx.matches_any(F.lower(text), (*CALENDAR_DATES, SHELF_LIFE))


#: The form of a field's text that its facts look at.
FORMS: dict[str, Callable[[Column], Column]] = {
    "mrp": tx.normalize_key, "net_quantity": quantity_digits, "unit_sale_price": tx.normalize_key,
    "manufacturer": tx.strip, "consumer_care": lambda v: v, **{field: tx.strip for field, _ in DATE_FIELDS},
}
#: By field what the format checks ask about a text that is given, in its form.
FACTS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "mrp": {
        "taxes": lambda v: tx.contains_any(v, TAX_PHRASES),
        "currency": lambda v: tx.contains_any(v, CURRENCY_MARKS),
        "number": lambda v: v.rlike(r"(?U)\d"),
    },
    "net_quantity": {
        "readable": lambda v: v.isNotNull(),
        "positive": _is_positive,
    },
    **{field: {"readable": lambda v: (v == "") | is_readable_date(v)} for field, _ in DATE_FIELDS},
    "consumer_care": {
        "email": lambda v: v.rlike(EMAIL),
        "phone": lambda v: F.length(F.regexp_replace(v, r"(?U)\D", "")) >= 10,
    },
    "unit_sale_price": {"unit": lambda v: tx.contains_any(v, UNIT_PRICE_PHRASES)},
    "manufacturer": {"long": lambda v: (v == "") | (F.length(v) >= 10)},
}


def facts_of(field: str, value: Column) -> Column:
    """The facts of a value as bits of a number."""
    form, bits = FORMS[field](value), F.lit(0)
    for i, found in enumerate(FACTS[field].values()):
        bits = bits + F.when(found(form), 1 << i).otherwise(0)
    return bits


def lacks(field: str, fact: str, by_value: Sequence[str]) -> Column:
    """The value is given and the fact doesn't hold."""
    if field in by_value:
        found = F.col(f"_facts_{field}").bitwiseAND(1 << list(FACTS[field]).index(fact)) != 0
    else:
        found = FACTS[field][fact](F.col(f"_form_{field}"))
    return tx.is_filled(F.col(field)) & ~found


def with_value_facts(labels: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Labels with the facts of the named fields, found once for each different value.

    The values of each field are gathered (equal ones are combined before they move) and written with
    their facts, and come back by a join: by broadcast where the written values are as small as the
    session allows for it, else both sides are dealt by the value. For fields whose values repeat; where they are mostly
    different, the joins cost more than the patterns.
    """
    unknown = [f for f in fields if f not in FACTS]
    if unknown:
        raise ValueError(f"no format check reads {', '.join(unknown)}")
    if not fields:
        return labels
    values = labels.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")).select("v.*")
    facts = F.lit(0)
    for field in fields:
        facts = F.when(F.col("field") == field, facts_of(field, F.col("value"))).otherwise(facts)
    different = values.where(tx.is_filled(F.col("value"))).distinct().withColumn("facts", facts)
    table = stored(different.select("value", "facts", "field"), "value-facts", "field")
    for field in fields:
        own = table.where(F.col("field") == field).select(
            F.col("value").alias("_value"), F.col("facts").alias(f"_facts_{field}"))
        labels = labels.join(own, F.col(field) == F.col("_value"), "left").drop("_value").withColumn(
            f"_facts_{field}", F.coalesce(f"_facts_{field}", F.lit(0)))
    return labels


# ---- format checks ------------------------------------------------------------

def mrp_format(by_value: Sequence[str] = ()) -> Column:
    return _found(
        when_violated(
            lacks("mrp", "taxes", by_value) & ~F.col("mrp_inclusive_of_taxes"),
            violation(
                rule_id="MRP_001", field="mrp", severity="high",
                message="MRP does not clearly state that it is inclusive of all taxes",
                suggestion="Use format: 'MRP Rs. XX.XX (Inclusive of all taxes)' "
                "or 'MRP ₹XX.XX incl. of all taxes'",
                detected_value=Sql("mrp"),
            ),
        ),
        when_violated(lacks("mrp", "currency", by_value), violation(
            rule_id="MRP_002", field="mrp", severity="medium",
            message="MRP does not contain currency indicator (Rs. / ₹)",
            suggestion="Prefix price with Rs. or ₹",
            detected_value=Sql("mrp"),
        )),
        when_violated(lacks("mrp", "number", by_value), violation(
            rule_id="MRP_003", field="mrp", severity="high",
            message="Could not detect a valid numeric price in MRP declaration",
            detected_value=Sql("mrp"),
        )),
    )


def qty_format(by_value: Sequence[str] = ()) -> Column:
    return _found(
        when_violated(lacks("net_quantity", "readable", by_value), violation(
            rule_id="QTY_001", field="net_quantity", severity="high",
            message="Net quantity is not in standard format (value + unit)",
            suggestion="Use standard units: g, kg, ml, L, m, cm, nos etc. "
            "Example: '200 g' or '500 ml'",
            detected_value=Sql("net_quantity"),
        )),
        when_violated(lacks("net_quantity", "positive", by_value), violation(
            rule_id="QTY_002", field="net_quantity", severity="high",
            message="Net quantity value must be positive",
            detected_value=Sql("net_quantity"),
        )),
    )


def date_format(by_value: Sequence[str] = ()) -> Column:
    found = []
    for field, label in DATE_FIELDS:
        found.append(when_violated(lacks(field, "readable", by_value), violation(
            rule_id=f"DATE_{field.upper()}", field=field, severity="medium",
            message=f"{label} does not appear to be in a readable date or shelf-life format",
            suggestion="Use a readable date such as 'Jan 2025', '01/2025', "
            "'January 2025', or a valid shelf-life declaration such as "
            "'24 Months From MFD'.",
            detected_value=Sql(f"_date_{field}"),
        )))
    return _found(*found)


def care_format(by_value: Sequence[str] = ()) -> Column:
    return _found(
        when_violated(lacks("consumer_care", "email", by_value), violation(
            rule_id="CARE_001", field="consumer_care", severity="high",
            message="Consumer care details must include a valid email address",
            suggestion="Email is mandatory under the Rules",
            detected_value=Sql("consumer_care"),
        )),
        when_violated(lacks("consumer_care", "phone", by_value), violation(
            rule_id="CARE_002", field="consumer_care", severity="medium",
            message="Consumer care details should include a contact phone / toll-free number",
            detected_value=Sql("consumer_care"),
        )),
    )


def usp_format(by_value: Sequence[str] = ()) -> Column:
    exempt = F.col("is_multi_piece") | F.col("is_combination") | F.col("is_ecommerce")
    return _found(when_violated(~exempt & lacks("unit_sale_price", "unit", by_value), violation(
        rule_id="USP_001", field="unit_sale_price", severity="medium",
        message="Unit Sale Price does not follow the required format "
        "(e.g. Rs. X.XX per g / per kg / per ml)",
        suggestion="Declare as 'Rs. 0.25 per g' or '₹12.50 per kg' etc. "
        "Round to 2 decimal places.",
        detected_value=Sql("unit_sale_price"),
    )))


def origin_format() -> Column:
    legal, why = LEGAL_TEXTS["country_of_origin"]
    return _found(when_violated(
        F.col("is_imported") & tx.is_blank(F.col("country_of_origin")),
        violation(
            rule_id="COO_001", field="country_of_origin", severity="high",
            message="Country of Origin is mandatory for imported products",
            suggestion="Declare as 'Country of Origin: XXX' or 'Made in XXX'",
            legal_reference=legal, explanation=why,
        ),
    ))


def mfr_format(by_value: Sequence[str] = ()) -> Column:
    legal, why = LEGAL_TEXTS["manufacturer"]
    return _found(when_violated(
        lacks("manufacturer", "long", by_value),
        violation(
            rule_id="MFR_001", field="manufacturer", severity="medium",
            message="Manufacturer / Packer / Importer name & address appears incomplete",
            suggestion="Must include name and complete address",
            detected_value=Sql("manufacturer"), legal_reference=legal,
            explanation=f"{why} The extracted declaration appears incomplete.",
        ),
    ))


def min_font_height(area: str) -> str:
    """Printed minimum letter height for a panel area."""
    cases = " ".join(
        f"when {area} >= {low} and {area} < {high} then '{mm}'" for low, high, mm in FONT_HEIGHTS
    )
    return f"(case {cases} else '{FONT_HEIGHT_LARGEST}' end)"


def font_size() -> Column:
    needed = min_font_height("pdp_area_cm2")
    printed = "format_number(estimated_font_height_mm, '0.0')"
    area = "format_number(pdp_area_cm2, '0')"
    too_small = F.expr(
        "pdp_area_cm2 is not null and estimated_font_height_mm is not null "
        f"and estimated_font_height_mm < cast({needed} as double)"
    )
    return when_violated(too_small, violation(
        rule_id="FONT_001", field="font_size", severity="high",
        message=Sql(
            f"concat('Font height (', {printed}, ' mm) is below the minimum required (', "
            f"{needed}, ' mm) for PDP area of ', {area}, ' cm²')"
        ),
        suggestion=Sql(
            "concat('Increase font size of mandatory declarations to at least ', "
            f"{needed}, ' mm')"
        ),
        detected_value=Sql(f"concat({printed}, ' mm')"),
        expected=Sql(f"concat('>= ', {needed}, ' mm')"),
    ))


# ---- result -------------------------------------------------------------------

def tally(violations: str) -> Column:
    """Points lost and violations per severity, in one pass."""
    weights = " ".join(
        f"when v.layer <=> 'product' and v.severity = '{name}' then {lost}"
        for name, lost in PRODUCT_LAYER_WEIGHTS.items()
    ) + " " + " ".join(
        f"when v.severity = '{name}' then {lost}" for name, lost in SEVERITY_WEIGHTS.items()
    )
    counts = ", ".join(
        f"'{name}', acc.{name} + int(v.severity = '{name}')" for name in ("high", "medium", "low")
    )
    return F.expr(
        f"aggregate({violations}, named_struct('lost', 0, 'high', 0, 'medium', 0, 'low', 0), "
        f"(acc, v) -> named_struct('lost', acc.lost + case {weights} else 5 end, {counts}))"
    )


def score(counts: str) -> Column:
    return F.expr(f"greatest(0D, least(100D, 100D - {counts}.lost))")


def missing_fields(violations: str) -> Column:
    """Distinct fields reported absent, sorted."""
    return F.expr(
        f"array_sort(array_distinct(transform(filter({violations}, "
        "v -> startswith(v.rule_id, 'PRESENCE_')), v -> v.field)))"
    )


def review_flag(confidence: str) -> Column:
    low = " or ".join(
        f"coalesce(try_element_at({confidence}, '{f}'), 1D) < {REVIEW_THRESHOLD}"
        for f in REVIEW_FIELDS
    )
    return F.expr(f"coalesce({low}, false)")


def layers() -> Column:
    return F.expr(
        "concat(array('universal'), "
        "if(rule_type_known, array(concat('category:', product_type)), array()), "
        "if(has_product_rules, array(concat('product:', specific_product)), array()))"
    )


def summary() -> Column:
    return F.expr("""
        case when is_compliant and score >= 90 then
          concat('Package appears COMPLIANT under ', product_type,
                 coalesce(concat(' (', specific_product, ')'), ''),
                 ' rules (Score: ', format_number(score, '0'), '/100).')
        when severity_counts.high = 0 then
          concat('Mostly compliant with ', severity_counts.medium, ' medium and ',
                 severity_counts.low, ' low issues (Score: ', format_number(score, '0'),
                 '/100). Review recommended.')
        else
          concat('NON-COMPLIANT: ', severity_counts.high, ' high-severity and ',
                 severity_counts.medium, ' medium-severity violations found (Score: ',
                 format_number(score, '0'), '/100).')
        end""")


def with_violations(df: DataFrame, rules: RuleSet, by_value: Sequence[str] = ()) -> DataFrame:
    """Add the ordered ``violations`` array; duplicates of a field are kept."""
    # Two steps keep each generated projection small.
    checked = with_rules(df, rules, by_value).withColumn("rule_violations", F.concat(
        presence(rules), conditional(), custom_checks(rules, "category"),
        product_mandatory(rules), custom_checks(rules, "product"),
    ))
    return checked.withColumn("violations", F.concat(
        F.col("rule_violations"), mrp_format(by_value), qty_format(by_value), date_format(by_value),
        care_format(by_value), usp_format(by_value), origin_format(), mfr_format(by_value), font_size(),
    ))


WORK_COLUMNS = (
    "rule_type", "required", "cat_exempted", "cat_checks", "rule_product",
    "extra_mandatory", "prod_exempted", "prod_checks", "has_product_rules",
    "rule_type_known", "rule_violations",
)


def check(df: DataFrame, rules: RuleSet, by_value: Sequence[str] = ()) -> DataFrame:
    """Score label rows; input columns are kept, result columns are added.

    One narrow stage, unless ``by_value`` names fields (any of ``FACTS``) whose values repeat so much that
    each different one is better checked once: labels are then read twice, and joined with what was found.
    """
    scored = (
        with_violations(df, rules, by_value)
        .withColumn("severity_counts", tally("violations"))
        .withColumns({
            "score": score("severity_counts"),
            "is_compliant": F.col("severity_counts.high") == 0,
            "missing_fields": missing_fields("violations"),
            "warnings": F.array().cast("array<string>"),
            "needs_manual_review": review_flag("ocr_confidence"),
            "rule_version": F.lit(RULE_VERSION),
            "layers_applied": layers(),
        })
    )
    done = scored.withColumn("summary", summary())
    work = [n for n in done.columns if n.startswith(("_date_", "_blank_", "_untrue_", "_lower_", "_facts_", "_form_"))]
    return done.drop(*WORK_COLUMNS, *work)
