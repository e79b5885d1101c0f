"""Rows of the inspection report. Labels and texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.operators.analytics import confidence_band

PRODUCT_CARD = (
    ("PRODUCT", "product_name"), ("GENERIC NAME", "generic_name"),
    ("NET QUANTITY", "net_quantity"), ("BRAND", "brand"),
    ("MANUFACTURER", "manufacturer_address"), ("COUNTRY OF ORIGIN", "country_of_origin"),
)
CHECKLIST = (
    ("Manufacturer", "manufacturer_address"), ("Generic / Common Name", "generic_name"),
    ("Net Quantity", "net_quantity"), ("Maximum Retail Price (MRP)", "mrp"),
    ("Consumer Care Details", "consumer_care"), ("Country of Origin", "country_of_origin"),
)
SCREEN_CHECKLIST = (
    ("Brand", "brand"), ("Product Name", "product_name"), ("Generic Name", "generic_name"),
    ("Net Quantity", "net_quantity"), ("MRP", "mrp"), ("Manufacturer", "manufacturer_address"),
    ("Consumer Care", "consumer_care"), ("Country of Origin", "country_of_origin"),
    ("Manufacturing Date", "mfg_date"),
)
CORRECTION_LABELS = {
    "brand": "Brand", "product_name": "Product Name", "generic_name": "Generic / Common Name",
    "net_quantity": "Net Quantity", "mrp": "Maximum Retail Price (MRP)",
    "manufacturer_address": "Manufacturer", "consumer_care": "Consumer Care",
    "country_of_origin": "Country of Origin", "mfg_date": "Manufacturing Date",
    "best_before": "Best Before", "use_by": "Use By / Expiry",
}
CONFIDENCE_FIELDS = (
    ("Brand", "brand"), ("Product Name", "product_name"),
    ("Generic / Common Name", "generic_name"), ("Net Quantity", "net_quantity"),
    ("MRP", "mrp"), ("Unit Sale Price", "unit_sale_price"),
    ("Manufacturer Address", "manufacturer_address"), ("Packer", "packer"),
    ("Importer", "importer"), ("Consumer Care", "consumer_care"),
    ("Manufacturing Date", "mfg_date"), ("Best Before", "best_before"),
    ("Use By / Expiry", "use_by"), ("Country of Origin", "country_of_origin"),
)
NOT_AVAILABLE = "Not available"


def safe(value: Column) -> Column:
    return tx.first_value(value.cast("string"), F.lit(NOT_AVAILABLE))


def product_card(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), safe(F.col(name)).alias("value"))
        for label, name in PRODUCT_CARD
    ])))


def checklist(df: DataFrame, key: str, fields=CHECKLIST) -> DataFrame:
    """Declared or missing; ``missing_fields`` names fields as the rules do."""
    listed = "missing_fields" in df.columns

    def status(name: str) -> Column:
        missing = ~tx.is_filled(F.col(name))
        if listed:
            missing = missing | F.coalesce(
                F.array_contains("missing_fields", F.lit(name)), F.lit(False)
            )
        return F.when(missing, "MISSING").otherwise("PRESENT")

    return df.select(key, F.inline(F.array(*[
        F.struct(
            F.lit(label).alias("requirement"), safe(F.col(name)).alias("detected_value"),
            status(name).alias("status"),
        )
        for label, name in fields
    ])))


def correction_rows(diff: DataFrame, key: str) -> DataFrame:
    """Officer corrections with display labels."""
    entries = [F.lit(x) for kv in CORRECTION_LABELS.items() for x in kv]
    label = F.coalesce(
        F.try_element_at(F.create_map(*entries), F.col("field")),
        F.initcap(F.translate(F.col("field"), "_", " ")),
    )
    return diff.select(
        key, label.alias("label"), safe(F.col("original")).alias("original"),
        safe(F.col("corrected")).alias("corrected"), F.lit("OFFICER VERIFIED").alias("status"),
    )


def percent_text(share: Column) -> Column:
    return F.concat(tx.fixed_decimals(share * 100, 0), F.lit("%"))


def confidence_rows(df: DataFrame, key: str, confidence: str = "field_confidence") -> DataFrame:
    """Percentage and level of every declaration field."""
    rows = F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            F.try_element_at(F.col(confidence), F.lit(name)).alias("c"),
        )
        for label, name in CONFIDENCE_FIELDS
    ])
    return df.select(key, F.inline(rows)).select(
        key, "label",
        F.coalesce(percent_text(F.col("c")), F.lit(NOT_AVAILABLE)).alias("confidence"),
        confidence_band(F.col("c")).alias("level"),
    )


def violation_rows(results: DataFrame, key: str) -> DataFrame:
    """Numbered violations with every gap filled."""
    shown = results.select(key, F.posexplode("violations").alias("pos", "v"))
    return shown.select(
        key, (F.col("pos") + 1).alias("number"),
        F.upper(safe(F.col("v.severity"))).alias("severity"),
        F.upper(safe(F.col("v.field"))).alias("field"),
        safe(F.col("v.message")).alias("message"),
        safe(F.col("v.suggestion")).alias("suggestion"),
        safe(F.col("v.detected_value")).alias("detected_value"),
    )


def fix_rows(fixes: DataFrame, key: str) -> DataFrame:
    """Suggested fixes as printed; ``number`` is the fix's place in its inspection."""
    return fixes.select(
        key, "number", safe(F.col("rule_id")).alias("rule_id"),
        F.upper(safe(F.col("field"))).alias("field"), safe(F.col("ai_fix")).alias("ai_fix"),
        safe(F.col("example")).alias("example"),
        F.coalesce(percent_text(F.col("confidence")), F.lit(NOT_AVAILABLE)).alias("confidence"),
    )


def status_row(results: DataFrame, key: str) -> DataFrame:
    good, review = F.col("is_compliant"), F.col("needs_manual_review")
    joined = F.array_join("layers_applied", " → ")
    return results.select(
        key, F.when(good, "PASS").otherwise("FAIL").alias("symbol"),
        F.when(good, "COMPLIANT").otherwise("NON-COMPLIANT").alias("status"),
        tx.fixed_decimals(F.col("score"), 1).alias("score"),
        F.when(review, "MANUAL REVIEW REQUIRED").otherwise("NO MANUAL REVIEW REQUIRED").alias(
            "review"
        ),
        safe(F.col("rule_version")).alias("rule_version"),
        F.when(F.size("layers_applied") > 0, joined).otherwise("None").alias("layers"),
    )
