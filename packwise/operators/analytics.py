"""Figures over inspection records: totals, trends, rankings, risk and officer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwise.functions import text as tx

# Display labels of known rules.
KNOWN_LABELS = {
    "PRESENCE_MRP": "MRP declaration missing",
    "PRESENCE_NET_QUANTITY": "Net quantity missing",
    "PRESENCE_MANUFACTURER": "Manufacturer details missing",
    "PRESENCE_CONSUMER_CARE": "Consumer care details missing",
    "CARE_001": "Consumer care details missing",
    "PRESENCE_COUNTRY_OF_ORIGIN": "Country of origin missing",
    "COUNTRY_OF_ORIGIN": "Country of origin missing",
    "PRESENCE_PACKER": "Packer details missing",
    "PRESENCE_IMPORTER": "Importer details missing",
    "PRESENCE_GENERIC_NAME": "Generic name missing",
    "MFG_DATE": "Manufacturing date issue",
    "BEST_BEFORE": "Best-before declaration issue",
}

# Risk limits, recency, review fields and confidence levels.
RISK_LIMITS = ((50, "Critical"), (70, "High"), (85, "Medium"))
ACTIVE_DAYS = 30
REVIEW_THRESHOLD = 0.5
REVIEW_FIELDS = (
    ("mrp", "MRP"), ("net_quantity", "Net Quantity"),
    ("manufacturer_address", "Manufacturer"), ("consumer_care", "Consumer Care"),
)
CONFIDENCE_LEVELS = ((0.9, "HIGH"), (0.7, "MEDIUM"))
SEARCHED = ("product_id", "officer_id", "officer_name", "officer_email", "department", "summary")


def as_time(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def points() -> Column:
    return F.coalesce(F.col("confidence_score"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def half_up(number: Column) -> Column:
    """Whole number as displayed: halves go up."""
    return F.floor(number + 0.5)


def kpis(records: DataFrame) -> DataFrame:
    """Totals over all records in one pass; zeros when there are none."""
    good = F.count_if("is_compliant")
    return records.agg(
        F.count("*").alias("total"),
        good.alias("compliant"),
        (F.count("*") - good).alias("non_compliant"),
        percent(good, F.count("*")).alias("compliance_rate"),
        F.coalesce(F.avg(points()), F.lit(0.0)).alias("average_score"),
        F.count_if("needs_manual_review").alias("manual_reviews"),
        F.coalesce(F.sum(F.size(F.coalesce("violations", F.array()))), F.lit(0)).alias(
            "total_violations"
        ),
    )


def today(records: DataFrame, as_of: str | Column) -> DataFrame:
    same_day = F.to_date("created_at") == F.to_date(as_time(as_of))
    return records.agg(F.count_if(same_day).alias("inspections_today"))


def daily(records: DataFrame, as_of: str | Column, days: int = 7) -> DataFrame:
    """The last days with their counts and average score; empty days count zero."""
    last = F.to_date(as_time(as_of))
    first = F.date_sub(last, days - 1)
    spine = records.sparkSession.range(1).select(
        F.explode(F.sequence(first, last)).alias("day")
    )
    start = first.cast("timestamp")
    end = F.date_add(last, 1).cast("timestamp")
    recent = records.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    per_day = recent.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("is_compliant").alias("good"),
        F.avg(points()).alias("average"),
    )
    zero = F.lit(0)
    return spine.join(per_day, "day", "left").select(
        "day", F.date_format("day", "E").alias("label"),
        F.coalesce("n", zero).alias("count"),
        F.coalesce("good", zero).alias("compliant"),
        F.coalesce(F.col("n") - F.col("good"), zero).alias("non_compliant"),
        F.coalesce("average", F.lit(0.0)).alias("average_score"),
    )


def rule_counts(records: DataFrame) -> DataFrame:
    """Violations per rule id; an empty id counts as UNKNOWN."""
    found = records.select(F.explode("violations").alias("v")).filter("v is not null")
    rule = F.coalesce(tx.empty_to_null(F.col("v.rule_id")), F.lit("UNKNOWN"))
    return found.groupBy(rule.alias("rule_id")).agg(F.count("*").alias("count"))


def top_rules(records: DataFrame, n: int = 5) -> DataFrame:
    return rule_counts(records).orderBy(F.desc("count"), "rule_id").limit(n)


def violation_label(raw: Column) -> Column:
    """Display label: known text, else underscores opened and word starts capitalised."""
    opened = F.regexp_replace(raw, "[_-]+", " ")
    chunks = F.split(opened, "(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    titled = F.array_join(F.transform(chunks, lambda w: F.when(
        w.rlike("^[a-z]"), F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))
    ).otherwise(w)), "")
    entries = [F.lit(x) for kv in KNOWN_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), raw), titled)


def label_counts(records: DataFrame) -> DataFrame:
    """Violations per display label; labels are made once per rule id, not per row."""
    violation = dict(records.select("violations.rule_id", "violations").dtypes)["violations"]
    raw = [F.col("v.rule_id")]
    if "message:" in violation:
        raw.append(F.col("v.message"))
    named = tx.first_value(*raw, F.lit("Unknown violation"))
    found = records.select(F.explode("violations").alias("v")).groupBy(named.alias("raw")).agg(
        F.count("*").alias("n")
    )
    return found.groupBy(violation_label(F.col("raw")).alias("name")).agg(
        F.sum("n").alias("count")
    )


def top_labels(records: DataFrame, n: int = 8) -> DataFrame:
    """Most frequent labels with their share of the largest count."""
    counts = label_counts(records).orderBy(F.desc("count"), "name").limit(n)
    # The window sees the n rows that are left, nothing more.
    largest = F.max("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("count") * 100.0 / largest)


def category_of(fields: str = "extracted_fields") -> Column:
    kind = F.lower(tx.first_value(
        F.col(f"{fields}.product_type"), F.col(f"{fields}.specific_product"), F.lit("Other")
    ))
    return (
        F.when(F.coalesce(F.col(f"{fields}.is_imported"), F.lit(False)), "Imported Goods")
        .when(kind.contains("food"), "Food")
        .when(kind.contains("cosmetic"), "Cosmetics")
        .when(kind.contains("electronic"), "Electronics")
        .when(kind.contains("beverage") | kind.contains("drink"), "Beverages")
        .otherwise("Other")
    )


def by_category(records: DataFrame) -> DataFrame:
    good = F.count_if("is_compliant")
    return records.groupBy(category_of().alias("name")).agg(
        F.count("*").alias("total"), good.alias("compliant"),
        percent(good, F.count("*")).alias("compliance_rate"),
    ).orderBy(F.desc("total"), "name")


def risk_band(score: Column) -> Column:
    band = F.lit("Low")
    for limit, name in reversed(RISK_LIMITS):
        band = F.when(score < limit, name).otherwise(band)
    return band


def risk_counts(records: DataFrame) -> DataFrame:
    band = risk_band(points())
    return records.agg(*[
        F.count_if(band == name).alias(name.lower())
        for name in ("Critical", "High", "Medium", "Low")
    ])


def by_officer(records: DataFrame, as_of: str | Column) -> DataFrame:
    """One row per officer; name, department and e-mail come from the newest record."""
    key = tx.first_value(
        F.col("officer_id"), F.col("officer_email"), F.col("officer_name"), F.lit("UNKNOWN")
    )
    newest = F.struct("created_at", "id")
    known = F.struct(
        tx.first_value(
            F.col("officer_name"), F.col("officer_id"), F.lit("Unknown Officer")
        ).alias("name"),
        tx.first_value(F.col("department"), F.lit("Not specified")).alias("department"),
        tx.first_value(F.col("officer_email"), F.lit("Not specified")).alias("email"),
    )
    good = F.count_if("is_compliant")
    latest = F.max("created_at")
    return records.groupBy(key.alias("officer")).agg(
        F.max_by(known, newest).alias("who"),
        F.count("*").alias("inspections"), good.alias("compliant"),
        percent(good, F.count("*")).alias("compliance_rate"),
        F.avg(points()).alias("average_score"), latest.alias("latest"),
        (latest > as_time(as_of) - F.expr(f"interval {ACTIVE_DAYS} days")).alias("active"),
    ).select(
        "officer", "who.*", "inspections", "compliant", "compliance_rate", "average_score",
        "latest", "active",
    ).orderBy(F.desc("inspections"), "officer")


def officer_summary(officers: DataFrame) -> DataFrame:
    return officers.agg(
        F.count_if("active").alias("active_officers"),
        F.coalesce(F.try_divide(F.sum("inspections") * 1.0, F.count("*")), F.lit(0.0)).alias(
            "average_per_officer"
        ),
    )


def officer(officers: DataFrame, key: str) -> DataFrame:
    return officers.filter(F.col("officer") == key)


def high_risk(records: DataFrame, n: int = 8) -> DataFrame:
    """Lowest scores with their risk band."""
    return (
        records.withColumn("score", points()).orderBy("score", "id").limit(n)
        .select("id", "product_id", "score", risk_band(F.col("score")).alias("risk"))
    )


def recent(records: DataFrame, n: int = 10) -> DataFrame:
    """Newest records with an event title."""
    title = (
        F.when(F.col("needs_manual_review"), "Manual review required")
        .when(~F.col("is_compliant"), "New non-compliant product detected")
        .otherwise("Compliant inspection completed")
    )
    return (
        records.orderBy(F.desc("created_at"), "id").limit(n)
        .select("id", "product_id", "created_at", "confidence_score", title.alias("title"))
    )


def search(records: DataFrame, query: str) -> DataFrame:
    """Records with the words in one of six columns, ignoring case; blank finds all."""
    wanted = query.strip().lower()
    if not wanted:
        return records
    hit = F.lit(False)
    for name in SEARCHED:
        if name in records.columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(wanted)), F.lit(False))
    return records.filter(hit)


def history(records: DataFrame) -> DataFrame:
    """Display rows of the inspection history."""

    def shown(name: str) -> Column:
        value = F.col(f"extracted_fields.{name}")
        return F.when(tx.has_text(value), value)

    title = tx.first_value(
        shown("product_name"), shown("generic_name"), F.col("product_id"),
        F.lit("Product inspection"),
    )
    return records.withColumn("title", title).select(
        "id", "title",
        F.when(shown("generic_name") != F.col("title"), shown("generic_name")).alias("detail"),
        shown("net_quantity").alias("net_quantity"),
        F.concat(F.lit("MRP ₹"), shown("mrp")).alias("mrp"),
        "created_at",
        F.when(F.col("is_compliant"), "Compliant").otherwise("Non-Compliant").alias("status"),
        F.concat(half_up(points()).cast("string"), F.lit("%")).alias("score"),
        F.col("needs_manual_review").alias("manual_review"),
    )


def review_queue(df: DataFrame, key: str = "product_id", confidence: str = "field_confidence",
                 threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Critical fields read with low confidence, with value and percentage."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("field"), F.lit(label).alias("label"), F.col(name).alias("value"),
            F.try_element_at(F.col(confidence), F.lit(name)).alias("confidence"),
        )
        for name, label in REVIEW_FIELDS
    ])
    return df.select(key, F.inline(rows)).filter(F.col("confidence") < threshold).withColumn(
        "percentage", half_up(F.col("confidence") * 100)
    )


def confidence_band(confidence: Column) -> Column:
    band = F.lit("LOW")
    for limit, name in reversed(CONFIDENCE_LEVELS):
        band = F.when(confidence >= limit, name).otherwise(band)
    return F.when(confidence.isNull(), "N/A").otherwise(band)
