"""Inspection records, officer corrections and suggested fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwise.functions import text as tx
from packwise.functions.keys import perhaps_among
from packwise.operators.compliance import check
from packwise.operators.mapping import map_to_rules
from packwise.operators.replies import reply_object
from packwise.schemas import BOOLEAN_FIELDS, LABEL_FIELDS
from packwise.sources.rules import RuleSet

RESULT_COLUMNS = (
    "is_compliant", "confidence_score", "summary", "needs_manual_review",
    "extracted_fields", "violations", "missing_fields", "warnings",
)
OFFICER_DEFAULTS = {
    "officer_id": "UNKNOWN", "officer_name": "", "officer_email": "",
    "department": "", "role": "",
}


def officer_info(users: DataFrame) -> DataFrame:
    """Officer columns of a user table; the e-mail stands in for a missing officer id."""
    def filled(name: str) -> Column:
        return F.coalesce(tx.empty_to_null(F.col(name)), F.lit(""))

    return users.select(
        F.col("user_id").alias("officer_user_id"),
        F.col("email").alias("officer_email"),
        tx.first_value(
            F.col("officer_id"), F.coalesce(F.col("email"), F.lit("UNKNOWN"))
        ).alias("officer_id"),
        filled("full_name").alias("officer_name"),
        filled("department").alias("department"),
        filled("role").alias("role"),
    )


def with_officers(labels: DataFrame, officers: DataFrame) -> DataFrame:
    """Labels with their officer's columns; before they are scored, fewer and shorter columns move."""
    return labels.join(officers, "officer_user_id", "left")


def to_records(results: DataFrame, officers: DataFrame | None = None, fallback_id: str = "job_product_id",
               fields=LABEL_FIELDS) -> DataFrame:
    """Scored labels joined with their officer, in record form; without ``officers`` they have the officer's columns."""
    joined = results if officers is None else with_officers(results, officers)
    own = [c for c in (joined if officers is None else officers).columns if c != "officer_user_id"]
    present = [f for f in fields if f in results.columns]
    filled = {
        name: F.coalesce(tx.empty_to_null(F.col(name)), F.lit(default)) if name in own
        else F.lit(default)
        for name, default in OFFICER_DEFAULTS.items()
    }
    product = [F.col(c) for c in ("product_id", fallback_id) if c in results.columns]
    keep = [c for c in ("id", "created_at") if c in results.columns]
    views = (
        F.coalesce(F.col("view_names"), F.array()) if "view_names" in results.columns
        else F.array()
    )
    return joined.select(
        *keep, "officer_user_id", *[v.alias(n) for n, v in filled.items()],
        tx.first_value(*product).alias("product_id"),
        views.cast("array<string>").alias("view_names"),
        F.coalesce("is_compliant", F.lit(False)).alias("is_compliant"),
        F.coalesce("score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("needs_manual_review", F.lit(False)).alias("needs_manual_review"),
        F.struct(*present).alias("extracted_fields"),
        F.col("violations"), F.col("missing_fields"), F.col("warnings"),
    )


def latest_record(records: DataFrame) -> DataFrame:
    """Newest record id of every (officer, product)."""
    return records.groupBy("officer_user_id", "product_id").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("id")
    )


def corrections_map(corrections: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Long corrections (key, field, corrected) -> one map per key, unknown fields dropped.

    With ``order`` the last correction of a field wins. A map has at most 22 entries.
    """
    known = corrections.filter(F.col("field").isin(*LABEL_FIELDS))
    rank = F.col(order) if order else F.coalesce("corrected", F.lit(""))
    last = known.groupBy(key, "field").agg(F.max_by(F.struct("corrected"), rank).alias("c"))
    return last.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "c.corrected"))).alias("corrections")
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Overlay corrected fields; an explicit null correction clears the field."""
    patched = {}
    for name in LABEL_FIELDS:
        if name not in df.columns:
            continue
        value = F.try_element_at(F.col("corrections"), F.lit(name))
        if name in BOOLEAN_FIELDS:
            value = F.when(value.isNotNull(), tx.to_bool(value))
        patched[name] = F.when(
            F.coalesce(F.map_contains_key("corrections", name), F.lit(False)), value
        ).otherwise(F.col(name))
    return df.join(corrections, key, "left").withColumns(patched).drop("corrections")


def recheck(df: DataFrame, corrections: DataFrame, rules: RuleSet, key: str,
            clear_confidence: bool = False) -> DataFrame:
    """Re-map and re-score corrected rows; reading confidence stays unless cleared."""
    fixed = apply_corrections(df, corrections, key)
    if clear_confidence:
        fixed = fixed.withColumn("ocr_confidence", F.lit(None).cast("map<string,double>"))
    return check(map_to_rules(fixed, keep=(key,)), rules)


def correction_diff(original: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Fields that differ from the first extraction."""
    names = [f for f in LABEL_FIELDS if f in original.columns and f in current.columns]
    was = original.select(key, F.struct(*names).alias("o"))
    now = current.select(key, F.struct(*names).alias("c"))
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("field"), F.col(f"o.{n}").cast("string").alias("original"),
            F.col(f"c.{n}").cast("string").alias("corrected"),
        )
        for n in names
    ])
    changed = F.filter(rows, lambda r: ~r["original"].eqNullSafe(r["corrected"]))
    return was.join(now, key).filter(~F.col("o").eqNullSafe(F.col("c"))).select(
        key, F.inline(changed)
    )


def upsert(records: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the result columns of the records named by ``updates``; hardly any other record moves."""
    new = updates.select("id", F.struct(*RESULT_COLUMNS).alias("_new"))
    named, others = perhaps_among(records, updates, "id")
    return named.join(new, "id", "left").select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in RESULT_COLUMNS else F.col(c)
        for c in records.columns
    ]).unionByName(others)


# ---- suggested fixes -------------------------------------------------------------

def explode_violations(results: DataFrame, key: str) -> DataFrame:
    return results.select("*", F.posexplode("violations").alias("number", "v")).withColumn(
        "number", F.col("number") + 1
    )


def fix_payloads(results: DataFrame, key: str, product_fields: tuple[str, ...]) -> DataFrame:
    """Request text per violation: the violation and the product's fields as JSON."""
    told = F.struct(
        *[
            F.col(f"v.{n}").alias(n)
            for n in ("rule_id", "field", "message", "severity", "detected_value", "expected",
                      "legal_reference", "explanation")
        ],
        F.col("v.suggestion").alias("existing_suggestion"),
    )
    payload = F.to_json(
        F.struct(told.alias("violation"), F.struct(*product_fields).alias("product_fields")),
        {"ignoreNullFields": "false"},
    )
    return explode_violations(results, key).select(
        key, "number", F.col("v.rule_id").alias("rule_id"), F.col("v.field").alias("field"),
        payload.alias("payload"),
    )


def fix_suggestions(violations: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Replies per violation, tidied; a failed reply falls back to the rule's suggestion.

    ``violations`` has (key, number, rule_id, field, suggestion), ``replies`` has
    (key, number, reply).
    """
    parsed = replies.select(key, "number", reply_object(F.col("reply")).alias("_reply"))

    def said(name: str) -> Column:
        return tx.strip(F.coalesce(F.try_element_at("_reply", F.lit(name)), F.lit("")))

    trust = F.coalesce(said("confidence").try_cast("double"), F.lit(0.0))
    ok = F.col("_reply").isNotNull()
    return violations.join(parsed, [key, "number"], "left").select(
        key, "number", "rule_id", "field",
        F.when(ok, said("ai_fix")).otherwise(F.col("suggestion")).alias("ai_fix"),
        F.when(ok, tx.empty_to_null(said("example"))).alias("example"),
        F.when(ok, tx.round_exact(tx.clamp01(trust), 3)).otherwise(0.0).alias("confidence"),
    )


def attach_fixes(violations: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """First suggestion with the same rule and field, beside each violation."""
    match = [key, "rule_id", "field"]
    first = fixes.groupBy(*match).agg(
        F.min_by(F.struct("ai_fix", "example", "confidence"), "number").alias("_fix")
    )
    return violations.join(first, match, "left").select(*violations.columns, "_fix.*")
