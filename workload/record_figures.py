"""Analytics queries (an_*), record sources and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from packwise.operators import analytics as a
from packwise.operators.registry import latest_record
from packwise.plans.inspection import compliance_by_category
from packwise.sources import records as rec
from packwise.sources.rules import load_rules
from packwise.sources.storage import new_folder
from workload.inputs import AS_OF, DUCK_RECORDS, label_fields, records, table
from workload.registry import query
from workload.rule_checks import DUCK_RESULT

R = f"WITH {DUCK_RECORDS} "


@query("flagship", f"""WITH {DUCK_RESULT} SELECT ptype AS product_type, count(*) AS labels,
 count(*) FILTER (is_compliant) AS compliant,
 round(count(*) FILTER (is_compliant) * 100.0 / count(*), 6) AS compliance_rate,
 round(avg(score), 6) AS average_score, CAST(sum(n) AS BIGINT) AS violations FROM result GROUP BY ptype""")
def flagship(spark, sf_dir):
    """Compliance by category: every label scored, then one small aggregate."""
    return compliance_by_category(label_fields(spark, sf_dir), load_rules(spark)).withColumns({
        "compliance_rate": F.round("compliance_rate", 6),
        "average_score": F.round("average_score", 6),
    })


@query("an_kpis", R + """SELECT count(*) AS total, count(*) FILTER (is_compliant) AS compliant,
 count(*) FILTER (NOT is_compliant) AS non_compliant,
 round(100.0 * count(*) FILTER (is_compliant) / count(*), 6) AS compliance_rate,
 round(avg(confidence_score), 6) AS average_score, count(*) FILTER (needs_manual_review) AS manual_reviews,
 (SELECT count(*) FROM record_violations) AS total_violations FROM records""")
def an_kpis(spark, sf_dir):
    return a.kpis(records(spark, sf_dir)).withColumns({
        c: F.round(c, 6) for c in ("compliance_rate", "average_score")})


@query("an_today", R + """SELECT count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-29')
 AS inspections_today FROM records""")
def an_today(spark, sf_dir):
    return a.today(records(spark, sf_dir), "2024-01-29 18:00:00")


@query("an_daily7", R + f"""SELECT CAST(d.day AS DATE) AS day, strftime(d.day, '%a') AS label,
 count(r.id) AS count, count(*) FILTER (r.is_compliant) AS compliant,
 count(*) FILTER (NOT r.is_compliant) AS non_compliant,
 round(coalesce(avg(r.confidence_score), 0), 6) AS average_score
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day) d
LEFT JOIN records r ON CAST(r.created_at AS DATE) = CAST(d.day AS DATE) GROUP BY d.day""")
def an_daily7(spark, sf_dir):
    return a.daily(records(spark, sf_dir), AS_OF).withColumn(
        "average_score", F.round("average_score", 6))


@query("an_top_rules", R + """SELECT coalesce(nullif(rule_id, ''), 'UNKNOWN') AS rule_id, count(*) AS count
FROM record_violations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def an_top_rules(spark, sf_dir):
    return a.top_rules(records(spark, sf_dir))


_LABEL = """CASE rule_id WHEN 'PRESENCE_MRP' THEN 'MRP declaration missing'
 WHEN 'CARE_001' THEN 'Consumer care details missing'
 WHEN 'PRESENCE_CONSUMER_CARE' THEN 'Consumer care details missing'
 WHEN 'QTY_001' THEN 'QTY 001' WHEN 'DATE_BEST_BEFORE' THEN 'DATE BEST BEFORE'
 WHEN '' THEN 'Unknown Violation' END"""


@query("an_top_labels", R + f"""SELECT name, count, round(count * 100.0 / max(count) OVER (), 6) AS share
FROM (SELECT {_LABEL} AS name, count(*) AS count FROM record_violations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)""")
def an_top_labels(spark, sf_dir):
    return a.top_labels(records(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("an_violation_label", """SELECT doc_id, upper(substr(source, 1, 1)) || substr(source, 2) || ' X' ||
 upper(substr(lang, 1, 1)) || substr(lang, 2) || ' 001' AS label
FROM (SELECT doc_id, lower(source) AS source, lower(lang) AS lang FROM documents)""")
def an_violation_label(spark, sf_dir):
    raw = F.concat(F.lower("source"), F.lit("__x"), F.initcap("lang"), F.lit("-001"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", a.violation_label(raw).alias("label"))


_CATEGORY = """CASE WHEN is_imported THEN 'Imported Goods' WHEN k LIKE '%food%' THEN 'Food'
 WHEN k LIKE '%cosmetic%' THEN 'Cosmetics' WHEN k LIKE '%electronic%' THEN 'Electronics'
 WHEN k LIKE '%beverage%' OR k LIKE '%drink%' THEN 'Beverages' ELSE 'Other' END"""


@query("an_category", R + f"""SELECT {_CATEGORY} AS name, count(*) AS total,
 count(*) FILTER (is_compliant) AS compliant,
 round(100.0 * count(*) FILTER (is_compliant) / count(*), 6) AS compliance_rate
FROM (SELECT *, coalesce(nullif(product_type, ''), specific_product, 'other') AS k FROM records) GROUP BY 1""")
def an_category(spark, sf_dir):
    return a.by_category(records(spark, sf_dir)).withColumn(
        "compliance_rate", F.round("compliance_rate", 6))


_RISK = """CASE WHEN confidence_score < 50 THEN 'Critical' WHEN confidence_score < 70 THEN 'High'
 WHEN confidence_score < 85 THEN 'Medium' ELSE 'Low' END"""


@query("an_risk_band", R + f"SELECT id, {_RISK} AS risk FROM records")
def an_risk_band(spark, sf_dir):
    return records(spark, sf_dir).select("id", a.risk_band(a.points()).alias("risk"))


@query("an_risk_counts", R + f"""SELECT count(*) FILTER (r = 'Critical') AS critical,
 count(*) FILTER (r = 'High') AS high, count(*) FILTER (r = 'Medium') AS medium,
 count(*) FILTER (r = 'Low') AS low FROM (SELECT {_RISK} AS r FROM records)""")
def an_risk_counts(spark, sf_dir):
    return a.risk_counts(records(spark, sf_dir))


_OFFICERS = f"""{DUCK_RECORDS}, newest AS (SELECT *, row_number() OVER (PARTITION BY officer_id
 ORDER BY created_at DESC, id DESC) AS rn FROM records),
officers AS (SELECT n.officer_id AS officer, coalesce(n.officer_name, n.officer_id) AS name, n.department,
 coalesce(nullif(n.officer_email, ''), 'Not specified') AS email, g.* EXCLUDE (officer_id),
 g.latest > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS active
 FROM newest n JOIN (SELECT officer_id, count(*) AS inspections, count(*) FILTER (is_compliant) AS compliant,
  round(100.0 * count(*) FILTER (is_compliant) / count(*), 6) AS compliance_rate,
  round(avg(confidence_score), 6) AS average_score, max(created_at) AS latest
  FROM records GROUP BY officer_id) g ON g.officer_id = n.officer_id WHERE n.rn = 1)"""


def _officers(spark, sf_dir):
    return a.by_officer(records(spark, sf_dir), AS_OF)


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("compliance_rate", "average_score")})


@query("an_officers", f"WITH {_OFFICERS} SELECT * FROM officers")
def an_officers(spark, sf_dir):
    return _rounded(_officers(spark, sf_dir))


@query("an_officer_summary", f"""WITH {_OFFICERS} SELECT count(*) FILTER (active) AS active_officers,
 round(sum(inspections) * 1.0 / count(*), 6) AS average_per_officer FROM officers""")
def an_officer_summary(spark, sf_dir):
    return a.officer_summary(_officers(spark, sf_dir)).withColumn(
        "average_per_officer", F.round("average_per_officer", 6))


@query("an_officer_detail", f"WITH {_OFFICERS} SELECT * FROM officers WHERE officer = 'OFC-8'")
def an_officer_detail(spark, sf_dir):
    return _rounded(a.officer(_officers(spark, sf_dir), "OFC-8"))


@query("an_high_risk", R + f"""SELECT id, product_id, confidence_score AS score, {_RISK} AS risk
FROM records ORDER BY confidence_score, id LIMIT 8""")
def an_high_risk(spark, sf_dir):
    return a.high_risk(records(spark, sf_dir))


@query("an_recent", R + """SELECT id, product_id, created_at, confidence_score,
 CASE WHEN needs_manual_review THEN 'Manual review required'
  WHEN NOT is_compliant THEN 'New non-compliant product detected'
  ELSE 'Compliant inspection completed' END AS title FROM records ORDER BY created_at DESC, id LIMIT 10""")
def an_recent(spark, sf_dir):
    return a.recent(records(spark, sf_dir))


@query("an_search", R + """SELECT id, product_id, officer_id FROM records
WHERE lower(coalesce(product_id, '') || chr(1) || officer_id || chr(1) || coalesce(officer_name, '') || chr(1) ||
 officer_email || chr(1) || department || chr(1) || summary) LIKE '%officer 1%'""")
def an_search(spark, sf_dir):
    return a.search(records(spark, sf_dir), " Officer 1").select("id", "product_id", "officer_id")


@query("an_history", R + """SELECT id, title, CASE WHEN generic_name <> title THEN generic_name END AS detail,
 net_quantity, 'MRP ₹' || mrp AS mrp, created_at,
 CASE WHEN is_compliant THEN 'Compliant' ELSE 'Non-Compliant' END AS status,
 CAST(CAST(floor(confidence_score + 0.5) AS BIGINT) AS VARCHAR) || '%' AS score,
 needs_manual_review AS manual_review
FROM (SELECT *, coalesce(nullif(trim(product_name), ''), generic_name, product_id, 'Product inspection') AS title
 FROM records)""")
def an_history(spark, sf_dir):
    return a.history(records(spark, sf_dir))


@query("an_confidence_band", R + """SELECT id, CASE WHEN c IS NULL THEN 'N/A' WHEN c >= 0.9 THEN 'HIGH'
 WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT id, CASE WHEN product_id IS NOT NULL THEN confidence_score / 100 END AS c FROM records)""")
def an_confidence_band(spark, sf_dir):
    share = F.when(F.col("product_id").isNotNull(), F.col("confidence_score") / 100)
    return records(spark, sf_dir).select("id", a.confidence_band(share).alias("level"))


@query("src_records", R + """SELECT id, created_at, officer_id, confidence_score FROM records
WHERE officer_user_id = 'user8' OR officer_id = 'OFC-9'""")
def src_records(spark, sf_dir):
    return rec.list_records(records(spark, sf_dir), "user8", "OFC-9", "officer").select(
        "id", "created_at", "officer_id", "confidence_score")


@query("src_records_page", R + """, numbered AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS n FROM records
 WHERE confidence_score > 90)
SELECT id, created_at, n FROM numbered WHERE n > 40 AND n <= 540""")
def src_records_page(spark, sf_dir):
    """Two pages of a stored registry, the second behind the last record of the first."""
    path = new_folder(spark, "registry")
    rec.write_records(records(spark, sf_dir).filter("confidence_score > 90"), path)
    last = rec.page_records(spark, path, 40).collect()[-1]
    page = rec.page_records(spark, path, 500, (last["created_at"], last["id"]))
    order = Window.orderBy(F.desc("created_at"), "id")
    return page.select("id", "created_at", (F.row_number().over(order) + 40).cast("bigint").alias("n"))


@query("sink_records", R + """SELECT officer_user_id, product_id, id FROM (SELECT *, row_number() OVER
 (PARTITION BY officer_user_id, product_id ORDER BY created_at DESC, id DESC) AS rn FROM records) WHERE rn = 1""")
def sink_records(spark, sf_dir):
    """Append every record to a registry, then find the newest id per officer and product."""
    path = new_folder(spark, "registry")
    rec.write_records(records(spark, sf_dir), path)
    return latest_record(rec.read_records(spark, path))
