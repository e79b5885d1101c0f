"""Registry (rg_*), report (rp_*), source and sink queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwise.operators import analytics, registry as rg, report as rp
from packwise.operators.compliance import check
from packwise.schemas import LABEL_FIELDS
from packwise.sources import fields_json, images as img, manifest
from packwise.sources.rules import load_rules
from packwise.sources import records as rec
from packwise.sources.storage import new_folder
from workload.image_checks import DUCK_IMAGES, images
from workload.inputs import DUCK_LABELS, DUCK_VIEWS, label_fields, table, view_fields
from workload.registry import query
from workload.rule_checks import DUCK_RESULT, scored_labels

V = f"WITH {DUCK_VIEWS} "
_KEYED = "product_id * 3 + CASE \"view\" WHEN 'front' THEN 0 WHEN 'back' THEN 1 ELSE 2 END AS k"


def keyed_fields(spark, sf_dir):
    """Extracted fields with one numeric key per inspection."""
    seat = F.when(F.col("view") == "front", 0).when(F.col("view") == "back", 1).otherwise(2)
    return view_fields(spark, sf_dir).withColumn("k", F.col("product_id") * 3 + seat)


def corrections(spark, sf_dir):
    """Officer corrections: a new care text, a cleared price, a ticked box, an unknown field."""
    rows = F.expr("""array(
        named_struct('field', 'consumer_care', 'corrected', 'help@example.com, 9876543210'),
        named_struct('field', 'mrp', 'corrected', cast(null as string)),
        named_struct('field', 'is_food', 'corrected', if(k % 2 = 0, 'true', 'no')),
        named_struct('field', 'rubbish', 'corrected', 'x'))""")
    long = keyed_fields(spark, sf_dir).select("k", F.inline(
        F.when(F.col("brand") == "", rows).otherwise(F.slice(rows, 1, 0))))
    return rg.corrections_map(long, "k")


_FIXED = f"""{DUCK_VIEWS}, was AS (SELECT *, {_KEYED} FROM view_fields), now AS (SELECT * REPLACE (
 CASE WHEN brand = '' THEN 'help@example.com, 9876543210' ELSE consumer_care END AS consumer_care,
 CASE WHEN brand = '' THEN NULL ELSE mrp END AS mrp,
 CASE WHEN brand = '' THEN k % 2 = 0 ELSE is_food END AS is_food) FROM was)"""


@query("rg_apply_corrections", f"WITH {_FIXED} SELECT k, {', '.join(LABEL_FIELDS)} FROM now")
def rg_apply_corrections(spark, sf_dir):
    fixed = rg.apply_corrections(keyed_fields(spark, sf_dir), corrections(spark, sf_dir), "k")
    return fixed.select("k", *LABEL_FIELDS)


_DIFF = f"""{_FIXED}, diff AS (SELECT k, 'consumer_care' AS field, w.consumer_care AS original, n.consumer_care AS corrected
  FROM was w JOIN now n USING (k) WHERE w.consumer_care IS DISTINCT FROM n.consumer_care
 UNION ALL SELECT k, 'mrp', w.mrp, n.mrp FROM was w JOIN now n USING (k) WHERE w.mrp IS DISTINCT FROM n.mrp
 UNION ALL SELECT k, 'is_food', CAST(w.is_food AS VARCHAR), CAST(n.is_food AS VARCHAR) FROM was w JOIN now n USING (k)
  WHERE w.is_food IS DISTINCT FROM n.is_food)"""


def _diff(spark, sf_dir):
    was = keyed_fields(spark, sf_dir)
    return rg.correction_diff(was, rg.apply_corrections(was, corrections(spark, sf_dir), "k"), "k")


@query("rg_correction_diff", f"WITH {_DIFF} SELECT * FROM diff")
def rg_correction_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("rp_corrections", f"""WITH {_DIFF} SELECT k, CASE field WHEN 'consumer_care' THEN 'Consumer Care'
 WHEN 'mrp' THEN 'Maximum Retail Price (MRP)' ELSE 'Is Food' END AS label, coalesce(nullif(original, ''), 'Not available') AS original,
 coalesce(nullif(corrected, ''), 'Not available') AS corrected, 'OFFICER VERIFIED' AS status FROM diff""")
def rp_corrections(spark, sf_dir):
    return rp.correction_rows(_diff(spark, sf_dir), "k")


# The rule twin runs over the corrected fields under the rule input's name.
_RULES_OF_FIXED = f"""{_FIXED}, mapped AS (SELECT k AS inspection_id, CASE WHEN lower(trim(product_type)) = 'general' THEN
  CASE WHEN is_food THEN 'food' WHEN is_cosmetic THEN 'cosmetics' WHEN is_electronic THEN 'electronic'
  WHEN is_imported THEN 'imported' ELSE 'general' END ELSE product_type END AS product_type, specific_product,
 manufacturer_address AS manufacturer, generic_name, net_quantity, mrp, mrp_inclusive_of_taxes, false AS mrp_declaration_detected,
 unit_sale_price, consumer_care, mfg_date, best_before, use_by, country_of_origin, is_imported, false AS is_multi_piece,
 NULL::DOUBLE AS pdp_area_cm2, NULL::DOUBLE AS estimated_font_height_mm, 1.0::DOUBLE AS mrp_confidence FROM now)"""
# Same checks, reading ``mapped`` in place of the recipe.
_RECHECK = _RULES_OF_FIXED + ", " + DUCK_RESULT[DUCK_RESULT.index("typed AS ("):].replace(
    "FROM label_fields),\nkeyed", "FROM mapped),\nkeyed")


@query("rg_recheck", f"""WITH {_RECHECK} SELECT inspection_id AS k, is_compliant, score, ptype AS product_type, rule_ids, summary
FROM result""")
def rg_recheck(spark, sf_dir):
    done = rg.recheck(keyed_fields(spark, sf_dir), corrections(spark, sf_dir), load_rules(spark), "k")
    return done.select("k", "is_compliant", "score", "product_type", F.array_join(
        F.transform("violations", lambda v: v["rule_id"]), ",").alias("rule_ids"), "summary")


def _officers(spark, sf_dir):
    """Users: some lack an officer id, a name or a role."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return rg.officer_info(c.select(
        key.alias("user_id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("OFC-"), key.cast("string"))).alias("officer_id"),
        F.when(key % 4 != 0, F.col("c_name")).alias("full_name"), F.col("c_mktsegment").alias("department"),
        F.lit("").alias("role")))


_OFFICERS = """officers AS (SELECT c_custkey AS officer_user_id, lower(c_name) || '@example.com' AS officer_email,
 CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) || '@example.com' ELSE 'OFC-' || c_custkey END AS officer_id,
 CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE '' END AS officer_name, c_mktsegment AS department FROM customer)"""


def _records(spark, sf_dir):
    labels = rg.with_officers(label_fields(spark, sf_dir).withColumn("officer_user_id", F.col("officer_no")),
                              _officers(spark, sf_dir))
    scored = check(labels, load_rules(spark)).withColumns({
        "id": F.col("inspection_id"),
        "job_product_id": F.concat(F.lit("job-"), F.col("inspection_id").cast("string")),
        "view_names": F.array(F.lit("front")),
    })
    return rg.to_records(scored)


@query("rg_record", f"""WITH {DUCK_RESULT}, {_OFFICERS} SELECT inspection_id AS id, r.created_at, coalesce(o.officer_id, 'UNKNOWN') AS officer_id,
 coalesce(o.officer_name, '') AS officer_name, coalesce(o.officer_email, '') AS officer_email, coalesce(o.department, '') AS department,
 '' AS role, 'job-' || inspection_id AS product_id, is_compliant, score AS confidence_score, summary, needs_manual_review,
 missing AS missing_fields, mrp, n AS violations FROM result r LEFT JOIN officers o ON o.officer_user_id = r.officer_no""")
def rg_record(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "id", "created_at", "officer_id", "officer_name", "officer_email", "department", "role",
        "product_id", "is_compliant", "confidence_score", "summary", "needs_manual_review",
        F.array_join("missing_fields", ",").alias("missing_fields"), F.col("extracted_fields.mrp").alias("mrp"),
        F.size("violations").cast("bigint").alias("violations"))


@query("rg_upsert", f"""WITH {DUCK_RESULT} SELECT inspection_id AS id, CASE WHEN is_imported THEN true ELSE is_compliant END AS is_compliant,
 CASE WHEN is_imported THEN 100 ELSE score END AS confidence_score, CASE WHEN is_imported THEN 'corrected' ELSE summary END AS summary,
 CASE WHEN is_imported THEN 0 ELSE n END AS violations FROM result""")
def rg_upsert(spark, sf_dir):
    """Imported goods were corrected: their eight result columns are replaced in the stored registry."""
    path = new_folder(spark, "registry")
    rec.write_records(_records(spark, sf_dir), path)
    stored = rec.read_records(spark, path)
    updates = stored.filter("extracted_fields.is_imported").withColumns({
        "is_compliant": F.lit(True), "confidence_score": F.lit(100.0), "summary": F.lit("corrected"),
        "violations": F.slice("violations", 1, 0)})
    rec.upsert_records(spark, path, updates)
    return rec.read_records(spark, path).select(
        "id", "is_compliant", "confidence_score", "summary",
        F.size("violations").cast("bigint").alias("violations"))


_NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY ord) AS number FROM vio)"""


@query("rg_ai_payload", f"""WITH {DUCK_RESULT}, {_NUMBERED} SELECT inspection_id, v.number, v.rule_id, v.field, CAST(to_json({{
 'violation': {{'rule_id': v.rule_id, 'field': v.field, 'message': v.message, 'severity': v.severity, 'detected_value': v.detected_value,
  'expected': v.expected, 'legal_reference': v.legal_reference, 'explanation': v.explanation, 'existing_suggestion': v.suggestion}},
 'product_fields': {{'generic_name': r.generic_name, 'mrp': r.mrp, 'is_imported': r.is_imported}}}}) AS VARCHAR) AS payload
FROM numbered v JOIN result r USING (inspection_id)""")
def rg_ai_payload(spark, sf_dir):
    payloads = rg.fix_payloads(
        scored_labels(spark, sf_dir), "inspection_id", ("generic_name", "mrp", "is_imported"))
    return payloads.withColumn("number", F.col("number").cast("bigint"))


def _violations(spark, sf_dir):
    """Violations as a written table: fixes join them several times over."""
    path = new_folder(spark, "violations")
    rg.explode_violations(scored_labels(spark, sf_dir), "inspection_id").select(
        "inspection_id", "number", "v.rule_id", "v.field", "v.suggestion").write.parquet(path)
    return spark.read.parquet(path)


def _fixes(spark, sf_dir):
    """Replies to every second violation; high confidences, odd ones and broken replies."""
    found = _violations(spark, sf_dir)
    kind = F.col("number") % 4
    reply = (
        F.when(kind == 0, F.concat(F.lit('{"ai_fix": " Print '), F.col("field"), F.lit('", "example": "", "confidence": 1.7}')))
        .when(kind == 1, F.lit("not json")).when(kind == 2, F.lit('{"ai_fix": "Check", "example": " MRP ", "confidence": "high"}'))
        .otherwise(F.lit('Sure: {"ai_fix": "Add", "example": "x", "confidence": 0.12345}'))
    )
    replies = found.filter("rule_id <> 'USP_001'").select("inspection_id", "number", reply.alias("reply"))
    return found, rg.fix_suggestions(found, replies, "inspection_id")


_FIXES = f"""{DUCK_RESULT}, {_NUMBERED}, fixes AS (SELECT inspection_id, number, rule_id, field,
 CASE WHEN rule_id = 'USP_001' OR number % 4 = 1 THEN suggestion WHEN number % 4 = 0 THEN 'Print ' || field
  WHEN number % 4 = 2 THEN 'Check' ELSE 'Add' END AS ai_fix,
 CASE WHEN rule_id = 'USP_001' THEN NULL WHEN number % 4 = 2 THEN 'MRP' WHEN number % 4 = 3 THEN 'x' END AS example,
 CASE WHEN rule_id = 'USP_001' THEN 0 WHEN number % 4 = 0 THEN 1 WHEN number % 4 = 3 THEN 0.123 ELSE 0 END::DOUBLE AS confidence
 FROM numbered)"""


@query("rg_ai_normalize", f"WITH {_FIXES} SELECT * FROM fixes")
def rg_ai_normalize(spark, sf_dir):
    return _fixes(spark, sf_dir)[1].withColumn("number", F.col("number").cast("bigint"))


@query("rg_ai_join", f"""WITH {_FIXES} SELECT n.inspection_id, n.number, n.rule_id, n.field, f.ai_fix, f.example, f.confidence
FROM numbered n JOIN (SELECT *, row_number() OVER (PARTITION BY inspection_id, rule_id, field ORDER BY number) AS rn FROM fixes) f
 ON f.inspection_id = n.inspection_id AND f.rule_id = n.rule_id AND f.field = n.field AND f.rn = 1""")
def rg_ai_join(spark, sf_dir):
    found, fixes = _fixes(spark, sf_dir)
    return rg.attach_fixes(found, fixes, "inspection_id").drop("suggestion").withColumn(
        "number", F.col("number").cast("bigint"))


# ---- report -----------------------------------------------------------------------


def _long(rows, *extra: str) -> str:
    return " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, coalesce(nullif({f}, ''), 'Not available') AS value FROM was" for label, f in rows)


@query("rp_product_card", f"WITH {_FIXED} " + _long((
    ("PRODUCT", "product_name"), ("GENERIC NAME", "generic_name"), ("NET QUANTITY", "net_quantity"), ("BRAND", "brand"),
    ("MANUFACTURER", "manufacturer_address"), ("COUNTRY OF ORIGIN", "country_of_origin"))))
def rp_product_card(spark, sf_dir):
    return rp.product_card(keyed_fields(spark, sf_dir), "k")


@query("rp_checklist", f"WITH {DUCK_RESULT} " + " UNION ALL ".join(
    f"""SELECT inspection_id, '{label}' AS requirement, coalesce(nullif({f}, ''), 'Not available') AS detected_value,
 CASE WHEN coalesce({f}, '') = '' OR list_contains(string_split(missing, ','), '{name}') THEN 'MISSING' ELSE 'PRESENT' END AS status FROM result"""
    for label, name, f in (
        ("Manufacturer", "manufacturer_address", "manufacturer"), ("Generic / Common Name", "generic_name", "generic_name"),
        ("Net Quantity", "net_quantity", "net_quantity"), ("Maximum Retail Price (MRP)", "mrp", "mrp"),
        ("Consumer Care Details", "consumer_care", "consumer_care"), ("Country of Origin", "country_of_origin", "country_of_origin"))))
def rp_checklist(spark, sf_dir):
    scored = scored_labels(spark, sf_dir).withColumn("manufacturer_address", F.col("manufacturer"))
    return rp.checklist(scored, "inspection_id")


def _with_confidence(spark, sf_dir):
    key = F.col("k")
    return keyed_fields(spark, sf_dir).withColumn("field_confidence", F.create_map(
        F.lit("mrp"), (key % 100) / 100, F.lit("net_quantity"), (key % 8) / 8,
        F.lit("consumer_care"), F.when(key % 2 == 0, F.lit(0.49))))


_C = {"mrp": "(k % 100) / 100.0::DOUBLE", "net_quantity": "(k % 8) / 8.0::DOUBLE",
      "consumer_care": "CASE WHEN k % 2 = 0 THEN 0.49::DOUBLE END"}


@query("rp_confidence", f"WITH {_FIXED} " + " UNION ALL ".join(
    f"""SELECT k, '{label}' AS label, coalesce(format('{{:.0f}}', c * 100) || '%', 'Not available') AS confidence,
 CASE WHEN c IS NULL THEN 'N/A' WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT k, {_C.get(f, 'NULL::DOUBLE')} AS c FROM was)""" for label, f in rp.CONFIDENCE_FIELDS))
def rp_confidence(spark, sf_dir):
    return rp.confidence_rows(_with_confidence(spark, sf_dir), "k")


@query("an_review_queue", f"WITH {_FIXED} " + " UNION ALL ".join(
    f"""SELECT k, '{f}' AS field, '{label}' AS label, {f} AS value, c AS confidence, CAST(floor(c * 100 + 0.5) AS BIGINT) AS percentage
FROM (SELECT *, {_C[f]} AS c FROM was) WHERE c < 0.5""" for f, label in (
        ("mrp", "MRP"), ("net_quantity", "Net Quantity"), ("consumer_care", "Consumer Care"))))
def an_review_queue(spark, sf_dir):
    return analytics.review_queue(_with_confidence(spark, sf_dir), "k")


@query("rp_violations", f"""WITH {DUCK_RESULT}, {_NUMBERED} SELECT inspection_id, number, upper(severity) AS severity, upper(field) AS field,
 message, coalesce(suggestion, 'Not available') AS suggestion, coalesce(nullif(detected_value, ''), 'Not available') AS detected_value FROM numbered""")
def rp_violations(spark, sf_dir):
    rows = rp.violation_rows(scored_labels(spark, sf_dir), "inspection_id")
    return rows.withColumn("number", F.col("number").cast("bigint"))


@query("rp_fix_rows", f"""WITH {_FIXES} SELECT inspection_id, number, rule_id, upper(field) AS field, coalesce(ai_fix, 'Not available') AS ai_fix,
 coalesce(example, 'Not available') AS example, format('{{:.0f}}', confidence * 100) || '%' AS confidence FROM fixes""")
def rp_fix_rows(spark, sf_dir):
    rows = rp.fix_rows(_fixes(spark, sf_dir)[1], "inspection_id")
    return rows.withColumn("number", F.col("number").cast("bigint"))


@query("rp_status", f"""WITH {DUCK_RESULT} SELECT inspection_id, CASE WHEN is_compliant THEN 'PASS' ELSE 'FAIL' END AS symbol,
 CASE WHEN is_compliant THEN 'COMPLIANT' ELSE 'NON-COMPLIANT' END AS status, format('{{:.1f}}', score) AS score,
 CASE WHEN needs_manual_review THEN 'MANUAL REVIEW REQUIRED' ELSE 'NO MANUAL REVIEW REQUIRED' END AS review,
 'LMPC_3Layer_2024' AS rule_version, replace(layers, ',', ' → ') AS layers FROM result""")
def rp_status(spark, sf_dir):
    return rp.status_row(scored_labels(spark, sf_dir), "inspection_id")


# ---- sources and sinks ---------------------------------------------------------------


@query("src_fields_json", f"""WITH {DUCK_LABELS} SELECT 'p' || officer_no AS product_folder, mrp, net_quantity, is_imported FROM (
 SELECT *, row_number() OVER (PARTITION BY officer_no ORDER BY inspection_id DESC) AS rn FROM label_fields) WHERE rn = 1""")
def src_fields_json(spark, sf_dir):
    """Field files written per product folder and read back; the last inspection counts."""
    path = new_folder(spark, "fields")
    out = label_fields(spark, sf_dir).select(
        F.concat(F.lit("p"), F.col("officer_no").cast("string")).alias("product_folder"),
        "inspection_id", "mrp", "net_quantity", "is_imported", "mrp_confidence")
    fields_json.write_json(out, path)
    read, _ = fields_json.read_fields(spark, path, extra="inspection_id bigint")
    latest = fields_json.latest_per_folder(read.withColumn("modified", F.col("inspection_id")))
    return latest.select("product_folder", "mrp", "net_quantity", "is_imported")


@query("src_fields_latest", f"""WITH {DUCK_LABELS} SELECT inspection_id, mrp, net_quantity FROM label_fields WHERE officer_no % 3 = 1""")
def src_fields_latest(spark, sf_dir):
    """Three folders of field files are written one after the other; the rows of the one written last count."""
    path, labels = new_folder(spark, "fields"), label_fields(spark, sf_dir)
    for folder in (2, 0, 1):
        own = labels.where(F.col("officer_no") % 3 == folder).select(
            F.lit(f"product_{folder}").alias("product_folder"), "inspection_id", "mrp", "net_quantity")
        fields_json.write_json(own, f"{path}/product_{folder}")
    read, _ = fields_json.read_fields(spark, path, extra="inspection_id bigint")
    return fields_json.latest_folder(read).select("inspection_id", "mrp", "net_quantity")


@query("src_fields_quarantine", f"""WITH {DUCK_LABELS} SELECT sha256('broken {{' || inspection_id) AS record, 1 AS files
 FROM label_fields WHERE inspection_id % 7 = 0""")
def src_fields_quarantine(spark, sf_dir):
    """Records that are no JSON, among field files: they come out aside, as they are."""
    path = new_folder(spark, "fields")
    whole = F.to_json(F.struct("inspection_id", "mrp", "net_quantity"))
    broken = F.concat(F.lit("broken {"), F.col("inspection_id").cast("string"))
    label_fields(spark, sf_dir).select(
        F.when(F.col("inspection_id") % 7 == 0, broken).otherwise(whole).alias("value")).write.text(path)
    _, bad = fields_json.read_fields(spark, path)
    return bad.groupBy(F.sha2("record", 256).alias("record")).agg(F.count_distinct("source_file").alias("files"))


@query("sink_result_json", f"""WITH {DUCK_RESULT} SELECT inspection_id, score, summary, n AS violations FROM result""")
def sink_result_json(spark, sf_dir):
    path = new_folder(spark, "results")
    fields_json.write_json(scored_labels(spark, sf_dir).select(
        "inspection_id", "score", "is_compliant", "summary", "violations", "missing_fields"), path)
    back = spark.read.schema(
        "inspection_id bigint, score double, summary string, violations array<struct<rule_id:string>>").json(path)
    return back.select("inspection_id", "score", "summary", F.size("violations").cast("bigint").alias("violations"))


@query("src_manifest_check", """WITH f AS (SELECT l_orderkey AS job_id, CASE l_linenumber WHEN 1 THEN 'front' WHEN 2 THEN 'back'
  WHEN 3 THEN 'side' ELSE 'top' END AS v, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity * 400000 END AS size,
  CASE WHEN l_returnflag = 'R' THEN 'text/plain' WHEN l_returnflag = 'A' THEN '' ELSE 'image/png' END AS mime FROM lineitem),
pv AS (SELECT job_id, v, count(*) AS n, bool_or(size = 0) AS e1, bool_or(size > 15728640) AS e2,
  bool_or(mime <> '' AND mime NOT LIKE 'image/%') AS e3 FROM f GROUP BY job_id, v),
pj AS (SELECT job_id, sum(n) AS files, bool_or(v = 'top' OR n > 1) AS bad,
  string_agg('The ' || v || ' image is empty. Choose another file.', '|' ORDER BY v) FILTER (e1 AND v <> 'top') AS m1,
  string_agg('The ' || v || ' image is larger than 15 MB.', '|' ORDER BY v) FILTER (e2 AND v <> 'top') AS m2,
  string_agg('The ' || v || ' file must be an image.', '|' ORDER BY v) FILTER (e3 AND v <> 'top') AS m3 FROM pv GROUP BY job_id)
SELECT o_orderkey AS job_id, CAST(coalesce(files, 0) AS BIGINT) AS files, concat_ws('|',
 CASE WHEN files IS NULL THEN 'Upload at least one of front, back, or side.' END,
 CASE WHEN bad THEN 'view_names must contain unique front/back/side entries' END, m1, m2, m3) AS errors
FROM orders LEFT JOIN pj ON job_id = o_orderkey""")
def src_manifest_check(spark, sf_dir):
    """Order lines stand for uploaded files, orders for jobs."""
    n = F.col("l_linenumber")
    files = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.when(n == 1, "front").when(n == 2, "back").when(n == 3, "side").otherwise("top").alias("view"),
        F.when(F.col("l_quantity") > 45, 0).otherwise(F.col("l_quantity") * 400000).alias("size_bytes"),
        F.when(F.col("l_returnflag") == "R", "text/plain").when(F.col("l_returnflag") == "A", "")
        .otherwise("image/png").alias("mime"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    return manifest.validate_manifest(files, jobs).withColumn("errors", F.array_join("errors", "|"))


@query("src_images", f"""WITH {DUCK_IMAGES} SELECT origin, width, height, CASE WHEN least(width, height) < 80 THEN
 'Image too small (' || width || 'x' || height || ')' END AS error FROM images""")
def src_images(spark, sf_dir):
    good, bad = img.accept_images(images(spark, sf_dir))
    return good.select("origin", "width", "height", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("origin", "width", "height", "error"))
