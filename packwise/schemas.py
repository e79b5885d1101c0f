"""Column sets and struct types shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 22 declaration fields and their defaults.
TEXT_FIELDS = (
    "brand", "product_name", "generic_name", "net_quantity", "mrp",
    "unit_sale_price", "manufacturer_address", "packer", "importer",
    "consumer_care", "mfg_date", "best_before", "use_by", "country_of_origin",
)
BOOLEAN_FIELDS = (
    "mrp_inclusive_of_taxes", "is_food", "is_cosmetic", "is_electronic",
    "is_imported", "has_shelf_life",
)
LABEL_FIELDS = (
    "brand", "product_name", "generic_name", "net_quantity", "mrp",
    "mrp_inclusive_of_taxes", "unit_sale_price", "manufacturer_address",
    "packer", "importer", "consumer_care", "mfg_date", "best_before",
    "use_by", "country_of_origin", "product_type", "specific_product",
    "is_food", "is_cosmetic", "is_electronic", "is_imported",
    "has_shelf_life",
)
DEFAULT_PRODUCT_TYPE = "general"

# Package faces an inspection may show, in display order.
VIEWS = ("front", "back", "side")

VIOLATION_FIELDS = (
    "rule_id", "field", "message", "severity", "suggestion",
    "detected_value", "expected", "layer", "legal_reference", "explanation",
)
VIOLATION = T.StructType([T.StructField(n, T.StringType()) for n in VIOLATION_FIELDS])

CONFIDENCE_MAP = T.MapType(T.StringType(), T.DoubleType())

# What the rule checks read, with the value an absent column stands for.
RULE_INPUT = {
    "manufacturer": ("string", None), "packer": ("string", None),
    "importer": ("string", None), "generic_name": ("string", None),
    "net_quantity": ("string", None), "mrp": ("string", None),
    "mrp_inclusive_of_taxes": ("boolean", False),
    "mrp_declaration_detected": ("boolean", False),
    "unit_sale_price": ("string", None), "mfg_date": ("string", None),
    "best_before": ("string", None), "use_by": ("string", None),
    "consumer_care": ("string", None), "country_of_origin": ("string", None),
    "dimensions": ("string", None), "product_type": ("string", "general"),
    "specific_product": ("string", None), "is_imported": ("boolean", False),
    "is_food": ("boolean", False), "is_cosmetic": ("boolean", False),
    "is_electronic": ("boolean", False), "is_multi_piece": ("boolean", False),
    "is_combination": ("boolean", False), "is_ecommerce": ("boolean", False),
    "is_wholesale": ("boolean", False), "has_shelf_life": ("boolean", False),
    "pdp_area_cm2": ("double", None),
    "estimated_font_height_mm": ("double", None),
    "ocr_confidence": ("map<string,double>", None),
    "raw_text": ("string", None), "image_path": ("string", None),
}


def label_field_type(name: str) -> str:
    return "boolean" if name in BOOLEAN_FIELDS else "string"


def label_field_default(name: str) -> Column:
    if name == "product_type":
        return F.lit(DEFAULT_PRODUCT_TYPE)
    if name in BOOLEAN_FIELDS:
        return F.lit(False)
    return F.lit(None).cast("string")


def with_rule_input_defaults(df: DataFrame) -> DataFrame:
    """Add absent rule-input columns; missing booleans count as false."""
    have = set(df.columns)
    added = {}
    for name, (kind, default) in RULE_INPUT.items():
        if name not in have:
            added[name] = F.lit(default).cast(kind)
        elif kind == "boolean":
            added[name] = F.coalesce(F.col(name).cast("boolean"), F.lit(default))
        elif kind == "double":
            added[name] = F.col(name).cast("double")
    return df.withColumns(added)
