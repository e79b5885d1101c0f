"""Label tables derived from the driver tables, same rows in Spark and DuckDB.

``{events}``-style names are filled with DataFrames in Spark and with view names
in DuckDB, so both engines read the same recipe text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

LABEL_FIELDS_SQL = """
SELECT e.event_id AS inspection_id, e.user_id AS officer_no, e.ts AS created_at,
 CASE WHEN e.event_id % 11 = 0 THEN NULL WHEN e.event_id % 13 = 0 THEN 'ACME'
      ELSE s.s_name || ', Plot 4, Pune' END AS manufacturer,
 CASE WHEN e.event_id % 17 = 0 THEN '  ' ELSE p.p_name END AS generic_name,
 CASE WHEN e.event_id % 19 = 0 THEN NULL WHEN e.event_id % 7 = 0 THEN 'one pack'
      WHEN e.event_id % 23 = 0 THEN '0 g'
      ELSE CAST(p.p_size * 10 AS STRING) || CASE WHEN e.event_id % 2 = 0 THEN ' g' ELSE ' ml' END
      END AS net_quantity,
 CASE WHEN e.event_id % 29 = 0 THEN NULL WHEN e.event_id % 71 = 0 THEN 'Rs. on pack'
      WHEN e.event_id % 5 = 0 THEN CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS STRING)
      ELSE 'MRP Rs. ' || CAST(CAST(floor(p.p_retailprice) AS BIGINT) AS STRING)
           || '.00 incl. of all taxes' END AS mrp,
 (e.event_id % 10 = 0) AS mrp_inclusive_of_taxes,
 (e.event_id % 58 = 0) AS mrp_declaration_detected,
 CASE WHEN e.event_id % 3 = 0 THEN NULL WHEN e.event_id % 4 = 0 THEN 'Rs 2'
      ELSE 'Rs. 0.25 per g' END AS unit_sale_price,
 CASE WHEN e.event_id % 6 = 0 THEN NULL WHEN e.event_id % 9 = 0 THEN '9876543210'
      WHEN e.event_id % 31 = 0 THEN 'help@example.com'
      ELSE 'care' || CAST(s.s_suppkey AS STRING) || '@example.com, 9876543210' END AS consumer_care,
 CASE WHEN e.event_id % 8 = 0 THEN 'soon' WHEN e.event_id % 12 = 1 THEN '05 March 2026'
      ELSE '0' || CAST(1 + e.event_id % 9 AS STRING) || '/2026' END AS mfg_date,
 CASE WHEN e.event_id % 4 = 0 THEN NULL WHEN e.event_id % 3 = 0 THEN '24 months'
      WHEN e.event_id % 5 = 0 THEN 'Twenty four months from packing'
      ELSE '24 Months From MFD' END AS best_before,
 CASE WHEN e.event_id % 37 = 0 THEN 'Jan 2027' WHEN e.event_id % 38 = 0 THEN 'see cap'
      ELSE NULL END AS use_by,
 CASE WHEN e.event_id % 14 = 0 THEN NULL WHEN s.s_nationkey % 2 = 0 THEN 'India'
      ELSE 'China' END AS country_of_origin,
 (s.s_nationkey % 2 = 1) AS is_imported,
 CASE WHEN e.event_id % 41 = 0 THEN 'imported' WHEN e.event_id % 43 = 0 THEN ' Wholesale '
      WHEN e.event_id % 47 = 0 THEN 'alcohol' WHEN e.event_id % 53 = 0 THEN 'seed'
      WHEN e.event_id % 61 = 0 THEN NULL WHEN e.event_id % 67 = 0 THEN 'drugs'
      WHEN e.event_id % 73 = 0 THEN 'multipiece' WHEN e.event_id % 79 = 0 THEN 'E-Commerce'
      WHEN e.event_type = 'click' THEN 'food' WHEN e.event_type = 'view' THEN 'cosmetic'
      WHEN e.event_type = 'purchase' THEN 'electronics'
      WHEN e.event_type = 'signup' THEN 'garment' ELSE 'toys' END AS product_type,
 CASE WHEN e.event_type = 'click' THEN 'Milk' WHEN e.event_type = 'view' THEN 'sunscreen'
      WHEN e.event_id % 3 = 0 THEN 'baby_food' WHEN e.event_id % 4 = 0 THEN 'charger'
      ELSE NULL END AS specific_product,
 (e.event_id % 59 = 0) AS is_multi_piece,
 CASE WHEN e.event_id % 3 = 0 THEN CAST(20 * (p.p_size % 50) AS DOUBLE) ELSE NULL END AS pdp_area_cm2,
 CASE WHEN e.event_id % 2 = 0 THEN CAST(e.event_id % 5 AS DOUBLE) + CAST(0.25 AS DOUBLE)
      ELSE NULL END AS estimated_font_height_mm,
 CASE WHEN e.event_id % 15 = 0 THEN CAST(0.45 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS mrp_confidence
FROM {events} e
JOIN {part} p ON p.p_partkey = e.event_id % (SELECT COUNT(*) FROM {part})
JOIN {supplier} s ON s.s_suppkey = e.event_id % (SELECT COUNT(*) FROM {supplier})
"""

LABEL_TEXT_SQL = """
SELECT inspection_id, 'Amul ' || coalesce(generic_name, '')
 || CASE WHEN net_quantity IS NULL THEN '' ELSE ' Net Qty: ' || net_quantity END
 || CASE WHEN mrp IS NULL THEN ' M.R.P' ELSE ' ' || mrp END
 || CASE WHEN unit_sale_price IS NULL THEN '' ELSE ' Unit sale price ' || unit_sale_price END
 || ' Manufactured by: ' || coalesce(manufacturer, 'Acme Foods, Pune')
 || ' Customer care: ' || coalesce(consumer_care, 'see pack')
 || ' MFD ' || mfg_date
 || CASE WHEN best_before IS NULL THEN '' ELSE ' Best before ' || best_before END
 || CASE WHEN use_by IS NULL THEN '' ELSE ' Expiry: 0' || CAST(1 + inspection_id % 9 AS STRING) || '/2027' END
 || CASE WHEN product_type = 'cosmetic' THEN ' Herbal shampoo'
         WHEN product_type = 'electronics' THEN ' USB charger'
         WHEN product_type = 'food' THEN ' fruit juice drink' ELSE '' END
 || CASE WHEN country_of_origin IS NULL THEN '' ELSE '. Made in ' || country_of_origin END AS raw_text
FROM {label_fields}
"""

RECORDS_SQL = """
SELECT e.event_id AS id, e.ts AS created_at, 'OFC-' || CAST(e.user_id AS STRING) AS officer_id,
 'user' || CAST(e.user_id AS STRING) AS officer_user_id,
 CASE WHEN e.user_id % 9 = 0 THEN NULL ELSE 'Officer ' || CAST(e.user_id AS STRING) END AS officer_name,
 CASE WHEN e.user_id % 4 = 0 THEN '' ELSE 'user' || CAST(e.user_id AS STRING) || '@example.com' END AS officer_email,
 CASE WHEN e.user_id % 2 = 0 THEN 'North' ELSE 'South' END AS department,
 CASE WHEN e.event_id % 40 = 0 THEN NULL ELSE 'PROD_' || CAST(e.event_id % 97 AS STRING) END AS product_id,
 greatest(CAST(0 AS DOUBLE), 100 - CAST(floor(e.value) AS DOUBLE)) AS confidence_score,
 (e.value < 40) AS is_compliant, (e.event_id % 15 = 0) AS needs_manual_review,
 CASE WHEN e.value < 40 THEN 'Package appears COMPLIANT' ELSE 'NON-COMPLIANT: review' END AS summary,
 CASE e.event_type WHEN 'click' THEN 'food' WHEN 'view' THEN 'cosmetics' WHEN 'purchase' THEN 'electronic'
      WHEN 'signup' THEN 'soft drink' ELSE '' END AS product_type,
 CASE WHEN e.event_type = 'error' AND e.value > 30 THEN 'health drink' ELSE NULL END AS specific_product,
 CASE WHEN e.event_id % 9 = 0 THEN NULL WHEN e.event_id % 10 = 0 THEN '  '
      ELSE 'Item ' || CAST(e.event_id % 50 AS STRING) END AS product_name,
 CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE 'Kind ' || CAST(e.event_id % 5 AS STRING) END AS generic_name,
 CASE WHEN e.event_id % 6 = 0 THEN NULL ELSE '250 g' END AS net_quantity,
 CASE WHEN e.event_id % 8 = 0 THEN NULL ELSE CAST(CAST(floor(e.value) AS BIGINT) AS STRING) END AS mrp,
 (e.event_id % 12 = 0) AS is_imported,
 (e.value < 20) AS v_mrp, (e.event_type = 'click') AS v_care, (e.event_type = 'view') AS v_no_care,
 (e.value >= 30 AND e.value < 60) AS v_qty, (e.value > 50) AS v_date, (e.value > 200) AS v_blank
FROM {events} e
"""

# flag, rule id, field, severity of the violations a record carries, in order
RECORD_VIOLATIONS = (
    ("v_mrp", "PRESENCE_MRP", "mrp", "high"),
    ("v_care", "CARE_001", "consumer_care", "high"),
    ("v_no_care", "PRESENCE_CONSUMER_CARE", "consumer_care", "high"),
    ("v_qty", "QTY_001", "net_quantity", "high"),
    ("v_date", "DATE_BEST_BEFORE", "best_before", "medium"),
    ("v_blank", "", "general", "low"),
)

OCR_LINES_DUCK = """
SELECT doc_id // 3 AS product_id,
 CASE doc_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'side' END AS "view",
 cand AS candidate, i - 1 AS line_no, lines[i] AS text,
 CAST(50 + (doc_id*31 + (i-1)*17 + crank*7) % 50 AS DOUBLE)/100 AS confidence,
 CAST(10 AS DOUBLE) AS x1, CAST(20*(i-1) + crank AS DOUBLE) AS y1,
 CAST(210 AS DOUBLE) AS x2, CAST(20*(i-1) + 18 + crank AS DOUBLE) AS y2
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d,
 (VALUES ('enhanced',0),('original',1),('sharpened',2)) v(cand, crank), range(1, 1+len(lines)) t(i)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of declared fields per inspection."""
    tables = {n: table(spark, sf_dir, n) for n in ("events", "part", "supplier")}
    return spark.sql(LABEL_FIELDS_SQL, **tables).withColumn(
        "ocr_confidence", F.create_map(F.lit("mrp"), F.col("mrp_confidence"))
    )


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recognised text per inspection."""
    return spark.sql(LABEL_TEXT_SQL, label_fields=label_fields(spark, sf_dir))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored inspection records with nested fields and violations."""
    flat = spark.sql(RECORDS_SQL, events=table(spark, sf_dir, "events"))
    violations = F.array_compact(F.array(*[
        F.when(F.col(flag), F.struct(
            F.lit(rule).alias("rule_id"), F.lit(field).alias("field"),
            F.lit(severity).alias("severity"),
        ))
        for flag, rule, field, severity in RECORD_VIOLATIONS
    ]))
    nested = ("product_type", "specific_product", "product_name", "generic_name",
              "net_quantity", "mrp", "is_imported")
    return flat.select(
        "id", F.col("created_at").cast("timestamp").alias("created_at"),
        "officer_id", "officer_user_id", "officer_name", "officer_email",
        "department", "product_id", "confidence_score", "is_compliant",
        "needs_manual_review", "summary",
        F.struct(*nested).alias("extracted_fields"), violations.alias("violations"),
    )


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )


def _variants() -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("candidate"), F.lit(rank).alias("crank"))
        for rank, name in enumerate(("enhanced", "original", "sharpened"))
    ])


def _view_keys() -> tuple[Column, Column]:
    doc = F.col("doc_id")
    view = F.when(doc % 3 == 0, "front").when(doc % 3 == 1, "back").otherwise("side")
    return F.floor(doc / 3).alias("product_id"), view.alias("view")


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document line and image variant, with its box."""
    lines = _document_lines(spark, sf_dir)
    doc, line, rank = F.col("doc_id"), F.col("line_no"), F.col("crank")
    top = (20 * line + rank).cast("double")
    return (
        lines.withColumn("variant", F.explode(_variants()))
        .select("*", "variant.*")
        .select(
            *_view_keys(), "candidate", "line_no", "text",
            ((50 + (doc * 31 + line * 17 + rank * 7) % 50).cast("double") / 100).alias("confidence"),
            F.array(
                F.array(F.lit(10.0), top), F.array(F.lit(210.0), top),
                F.array(F.lit(210.0), top + 18), F.array(F.lit(10.0), top + 18),
            ).alias("polygon"),
        )
    )


# ---- DuckDB side ---------------------------------------------------------------

_VIEWS = {"events": "events", "part": "part", "supplier": "supplier",
          "label_fields": "label_fields"}

DUCK_LABELS = f"label_fields AS ({LABEL_FIELDS_SQL.format(**_VIEWS)})"
DUCK_TEXT = f"{DUCK_LABELS}, label_text AS ({LABEL_TEXT_SQL.format(**_VIEWS)})"
DUCK_LINES = f"ocr_lines AS ({OCR_LINES_DUCK})"
DUCK_RECORDS = (
    f"records AS ({RECORDS_SQL.format(**_VIEWS)}), record_violations AS ("
    + " UNION ALL ".join(
        f"SELECT id, {n} AS ord, '{rule}' AS rule_id, '{field}' AS field, "
        f"'{severity}' AS severity FROM records WHERE {flag}"
        for n, (flag, rule, field, severity) in enumerate(RECORD_VIOLATIONS)
    )
    + ")"
)

# ---- label lines per view, for the evidence and merge queries ---------------------

# Three inspections make one product with its front, back and side view.
VIEW_FIELDS_SQL = """
SELECT CAST(floor(inspection_id / 3) AS BIGINT) AS product_id,
 CASE inspection_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'side' END AS view,
 CASE WHEN inspection_id % 4 = 0 THEN '' WHEN inspection_id % 9 = 0 THEN 'Sold by Amul, India' ELSE 'Amul' END AS brand,
 generic_name AS product_name, generic_name, net_quantity, mrp, mrp_inclusive_of_taxes, unit_sale_price,
 manufacturer AS manufacturer_address, CAST(NULL AS {text}) AS packer, CAST(NULL AS {text}) AS importer,
 consumer_care, mfg_date, best_before, use_by, country_of_origin,
 coalesce(product_type, 'general') AS product_type, specific_product,
 (product_type = 'food') AS is_food, (product_type = 'cosmetic') AS is_cosmetic,
 (product_type = 'electronics') AS is_electronic, is_imported,
 CASE WHEN best_before IS NOT NULL THEN true ELSE NULL END AS has_shelf_life
FROM {label_fields}
"""

# The same views as printed lines; letter case and wording differ from the fields.
LABEL_LINES_SQL = """
SELECT CAST(floor(inspection_id / 3) AS BIGINT) AS product_id,
 CASE inspection_id % 3 WHEN 0 THEN 'front' WHEN 1 THEN 'back' ELSE 'side' END AS view,
 CAST(line_no AS BIGINT) AS line_no,
 CASE line_no WHEN 0 THEN 'AMUL  ' || upper(coalesce(generic_name, 'item'))
  WHEN 1 THEN coalesce(mrp, 'M.R.P') || ' ' || coalesce(net_quantity, '')
  WHEN 2 THEN 'Manufactured by ' || coalesce(manufacturer, 'Acme Foods') || ' Unit ' || coalesce(unit_sale_price, '')
  WHEN 3 THEN 'Care: ' || coalesce(consumer_care, '') || ' Best ' || coalesce(best_before, '') || ' Mfd ' || mfg_date
  ELSE coalesce(country_of_origin, ' ') END AS text,
 CAST((inspection_id * 7 + line_no * 13) % 41 + 59 AS DOUBLE) / 100 AS confidence,
 CAST(10 + line_no AS DOUBLE) AS x1, CAST(30 * line_no AS DOUBLE) + CAST(0.125 AS DOUBLE) AS y1,
 CAST(200 + inspection_id % 50 AS DOUBLE) AS x2, CAST(30 * line_no + 20 AS DOUBLE) AS y2
FROM (SELECT *, {five} AS line_no FROM {label_fields}) f
"""

DUCK_VIEWS = f"{DUCK_LABELS}, view_fields AS (" + VIEW_FIELDS_SQL.format(
    label_fields="label_fields", text="VARCHAR") + ")"
DUCK_LABEL_LINES = f"{DUCK_VIEWS}, label_lines AS (" + LABEL_LINES_SQL.format(
    label_fields="label_fields", five="unnest([0, 1, 2, 3, 4])") + ")"


def view_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted fields per product view."""
    sql = VIEW_FIELDS_SQL.replace("{text}", "STRING")
    return spark.sql(sql, label_fields=label_fields(spark, sf_dir))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines per product view, with their polygon."""
    sql = LABEL_LINES_SQL.replace("{five}", "explode(array(0, 1, 2, 3, 4))")
    flat = spark.sql(sql, label_fields=label_fields(spark, sf_dir))
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    return flat.select("product_id", "view", "line_no", "text", "confidence", F.array(
        corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"),
    ).alias("polygon"))


# Codes read on documents: data is every word of every line and variant, or a constant.
CODE_SCANS_SQL = """
SELECT product_id, view, CASE (product_id + line_no) % 3 WHEN 0 THEN 'gray' WHEN 1 THEN 'equalised' ELSE 'original' END AS scan_pass,
 CASE WHEN line_no % 2 = 0 THEN 'QRCODE' ELSE ' EAN13 ' END AS type,
 CASE WHEN product_id % 2 = 0 THEN word ELSE '8901234567890' END AS data, CAST(line_no AS BIGINT) * 100000 + place AS position
FROM {all_words}
"""
DUCK_CODES = f"{DUCK_LINES}, code_scans AS (" + CODE_SCANS_SQL.format(
    all_words="""(SELECT product_id, "view", line_no, p AS place, ws[p + 1] AS word FROM
 (SELECT *, string_split(text, ' ') AS ws FROM ocr_lines), range(0, len(ws)) w(p))""") + ")"


def code_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's words are the same in all its variants, so they are divided once."""
    words = _document_lines(spark, sf_dir).select(
        *_view_keys(), "line_no", F.posexplode(F.split("text", " ", -1)).alias("place", "word"))
    words = words.withColumn("variant", F.explode(_variants())).drop("variant")
    return spark.sql(CODE_SCANS_SQL, all_words=words)
