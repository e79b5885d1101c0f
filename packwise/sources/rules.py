"""Rule tables: shipped facts or a layered YAML directory -> two DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwise.sources import rulebook

SEVERITIES = ("high", "medium", "low", "info")

# Rule tables go to every task; one of more bytes (as JSON) than this is refused at load.
RULE_BYTES = 64 << 20

REQUIRED_DDL = (
    "array<struct<field:string,severity:string,label:string,"
    "legal_reference:string,explanation:string>>"
)
CHECK_DDL = (
    "array<struct<rule_id:string,field:string,message:string,severity:string,"
    "suggestion:string,legal_reference:string,explanation:string,"
    "condition:string,expected:array<string>>>"
)
EXTRA_DDL = "array<struct<field:string,severity:string,message:string,suggestion:string>>"
CATEGORY_DDL = (
    f"rule_type string, required {REQUIRED_DDL}, cat_exempted array<string>, "
    f"cat_checks {CHECK_DDL}"
)
PRODUCT_DDL = (
    f"rule_product string, extra_mandatory {EXTRA_DDL}, "
    f"prod_exempted array<string>, prod_checks {CHECK_DDL}"
)


@dataclass(frozen=True)
class RuleSet:
    """Rule tables plus the few facts the plan needs while it is built."""

    categories: DataFrame
    products: DataFrame
    category_names: tuple[str, ...]
    product_names: tuple[str, ...]
    fields: dict[str, tuple[str, ...]]  # fields named by required, extra and custom rules
    longest: dict[str, int]  # rule list column -> entries in its longest row

    def category_side(self) -> DataFrame:
        return F.broadcast(self.categories)

    def product_side(self) -> DataFrame:
        return F.broadcast(self.products)


def _severity(value, where: str, default: str) -> str:
    severity = default if value is None else value
    if severity not in SEVERITIES:
        raise ValueError(f"{where}: unknown severity {severity!r}")
    return severity


def _text(value):
    return None if value is None else str(value)


def _required(rule: dict, where: str) -> list[tuple]:
    """Base fields first, then the category's own; the category's wording wins."""
    rows = {}
    for field, (severity, label) in rulebook.BASE_MANDATORY.items():
        rows[field] = (field, severity, label, *rulebook.LEGAL_TEXTS.get(field, (None, None)))
    for field, conf in (rule.get("mandatory") or {}).items():
        legal, why = rulebook.LEGAL_TEXTS.get(field, (None, None))
        rows[field] = (
            field,
            _severity(conf.get("severity"), f"{where}.{field}", "high"),
            str(conf.get("label", field)),
            _text(conf.get("legal_reference", legal)),
            _text(conf.get("explanation", why)),
        )
    return list(rows.values())


def _checks(rule: dict, where: str) -> list[tuple]:
    """Checks with a condition; the first condition named decides, the rest is advice."""
    rows = []
    for check in rule.get("custom_checks") or []:
        severity = _severity(
            check.get("severity"), f"{where}.{check.get('rule_id')}", "medium"
        )
        expected = None
        if check.get("must_exist"):
            condition = "must_exist"
        elif "expected_contains" in check:
            condition = "contains_any"
            expected = [str(check["expected_contains"]).strip().lower()]
        elif "expected_any" in check:
            condition = "contains_any"
            expected = [str(e).strip().lower() for e in check["expected_any"] or []]
        elif check.get("must_not_exist"):
            condition = "must_not_exist"
        else:
            continue
        rows.append((
            str(check.get("rule_id", "CUSTOM")), check.get("field"),
            str(check.get("message", "Custom rule failed")), severity,
            _text(check.get("suggestion")), _text(check.get("legal_reference")),
            _text(check.get("explanation")), condition, expected,
        ))
    return rows


def _extra(rule: dict, where: str) -> list[tuple]:
    rows = []
    for item in rule.get("extra_mandatory") or []:
        field = item.get("field")
        if not field:
            continue
        rows.append((
            field,
            _severity(item.get("severity"), f"{where}.{field}", "medium"),
            str(item.get("label", f"Missing field for this product: {field}")),
            _text(item.get("note")),
        ))
    return rows


def _rule_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rule rows as a constant relation, so reading them starts no job."""
    schema = T.StructType.fromDDL(ddl)
    text = json.dumps([_named(r, schema) for r in rows])
    return spark.sql(
        "SELECT inline(from_json(:rows, :ddl))",
        args={"rows": text, "ddl": f"array<struct<{schema.simpleString()[7:-1]}>>"},
    )


def _named(value, kind: T.DataType):
    if isinstance(kind, T.StructType) and value is not None:
        return {f.name: _named(v, f.dataType) for f, v in zip(kind.fields, value)}
    if isinstance(kind, T.ArrayType) and value is not None:
        return [_named(v, kind.elementType) for v in value]
    return value


def compile_rules(
    spark: SparkSession, categories: dict[str, dict], products: dict[str, dict]
) -> RuleSet:
    """Check the rule facts once and turn them into join tables."""
    cat_rows = []
    for key, r in categories.items():
        if not r:  # an empty file: the type is known, but nothing applies to it
            continue
        exempted = list(r.get("exempted") or [])
        required = [x for x in _required(r, key) if x[0] not in exempted]
        cat_rows.append((key, required, exempted, _checks(r, key)))
    prod_rows = [
        (key, _extra(r, key), list(r.get("exempted") or []), _checks(r, key))
        for key, r in products.items() if r
    ]
    for name, rows in (("category", cat_rows), ("product", prod_rows)):
        if (size := len(json.dumps(rows))) > RULE_BYTES:
            raise ValueError(f"the {name} rules take {size} bytes; at most {RULE_BYTES} can go to every task")
    lists = {
        "required": [r[1] for r in cat_rows], "cat_checks": [r[3] for r in cat_rows],
        "extra_mandatory": [r[1] for r in prod_rows], "prod_checks": [r[3] for r in prod_rows],
    }
    fields = {
        "required": {x[0] for row in lists["required"] for x in row},
        "extra": {x[0] for row in lists["extra_mandatory"] for x in row},
        "checks": {
            x[1] for n in ("cat_checks", "prod_checks") for row in lists[n] for x in row if x[1]
        },
    }
    return RuleSet(
        _rule_table(spark, cat_rows, CATEGORY_DDL),
        _rule_table(spark, prod_rows, PRODUCT_DDL),
        tuple(categories), tuple(products),
        {kind: tuple(sorted(names)) for kind, names in fields.items()},
        {name: max(map(len, rows), default=0) for name, rows in lists.items()},
    )


def _key(rule: dict, name: str, fallback: str) -> str:
    return str(rule.get(name) or fallback).lower().strip()


def _read_yaml(path: Path) -> dict:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a rule directory needs PyYAML") from exc
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def read_rule_files(rules_dir: str) -> tuple[dict[str, dict], dict[str, dict]]:
    """``categories/``, ``products/`` and flat files of a rule directory.

    A flat file in the root acts as a category when its key is new.
    """
    root = Path(rules_dir)
    categories, products = {}, {}
    for path in sorted((root / "categories").glob("*.yaml")):
        rule = _read_yaml(path)
        categories[_key(rule, "product_type", path.stem)] = rule
    for path in sorted(root.glob("*.yaml")):
        if path.name != "universal.yaml":
            rule = _read_yaml(path)
            categories.setdefault(_key(rule, "product_type", path.stem), rule)
    for path in sorted((root / "products").glob("*.yaml")):
        rule = _read_yaml(path)
        products[_key(rule, "product", path.stem)] = rule
    return categories, products


def load_rules(spark: SparkSession, rules_dir: str | None = None) -> RuleSet:
    if rules_dir is not None:
        categories, products = read_rule_files(rules_dir)
    else:
        categories = {r["product_type"]: r for r in rulebook.CATEGORIES}
        products = {r["product"]: r for r in rulebook.PRODUCTS}
    return compile_rules(spark, categories, products)
