"""Evidence (ln_*, code_*) and view merge (fv_*) queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwise.functions import geometry as g
from packwise.functions import text as tx
from packwise.operators import evidence as ev
from packwise.operators import view_merge as vm
from packwise.plans.inspection import inspect_lines, inspect_products, merged_lines
from packwise.schemas import LABEL_FIELDS, TEXT_FIELDS
from packwise.sources.rules import load_rules
from packwise.sources.storage import stored
from workload.inputs import (
    AS_OF, DUCK_CODES, DUCK_LABEL_LINES, DUCK_LINES, DUCK_VIEWS, code_scans, label_lines,
    ocr_lines, table, view_fields,
)
from workload.registry import query

L = f"WITH {DUCK_LINES} "
_TIDY = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_KEY = f"lower({_TIDY})"


@query("ln_filter_clean", L + f"""SELECT product_id, "view", candidate, CAST(line_no AS BIGINT) AS line_no, {_TIDY} AS text
FROM ocr_lines WHERE {_TIDY} <> ''""")
def ln_filter_clean(spark, sf_dir):
    return ev.clean_lines(ocr_lines(spark, sf_dir)).select(
        "product_id", "view", "candidate", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query("ln_normalize_key", f"SELECT doc_id, md5({_KEY}) AS key FROM documents")
def ln_normalize_key(spark, sf_dir):
    """Match keys of whole texts, compared by digest."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(tx.normalize_key(F.col("text")).cast("binary")).alias("key"))


# A second box of the line, moved and partly degenerate.
_MOVED = """moved AS (SELECT product_id, "view", candidate, CAST(line_no AS BIGINT) AS line_no, x1, y1, x2, y2,
 x1 + 25 * (line_no % 10) AS bx1, y1 + 3 * (line_no % 7) AS by1,
 CASE WHEN line_no % 6 = 5 THEN x1 + 25 * (line_no % 10) ELSE x2 + 25 * (line_no % 10) END AS bx2,
 y2 + 3 * (line_no % 7) AS by2 FROM ocr_lines)"""


def _with_moved(spark, sf_dir):
    n = F.col("line_no")
    dx, dy = 25.0 * (n % 10), 3.0 * (n % 7)
    flat = F.when(n % 6 == 5, 0.0).otherwise(1.0)
    left = F.col("polygon")[0][0] + dx
    moved = F.transform("polygon", lambda p: F.array(
        left + (p[0] + dx - left) * flat, p[1] + dy))
    return ocr_lines(spark, sf_dir).withColumn("other", moved).withColumn("line_no", n.cast("bigint"))


@query("ln_bbox", f"""WITH {DUCK_LINES}, {_MOVED} SELECT product_id, "view", candidate, line_no,
 CASE WHEN bx2 > bx1 THEN bx1 END AS x1, CASE WHEN bx2 > bx1 THEN by1 END AS y1,
 CASE WHEN bx2 > bx1 THEN bx2 END AS x2, CASE WHEN bx2 > bx1 THEN by2 END AS y2,
 bx1 || ',' || by1 || ',' || bx2 || ',' || by2 AS corners FROM moved""")
def ln_bbox(spark, sf_dir):
    return _with_moved(spark, sf_dir).withColumn("b", g.box_of(F.col("other"))).select(
        "product_id", "view", "candidate", "line_no", *[F.col(f"b.{c}").alias(c) for c in g.CORNERS],
        F.array_join(g.rounded_box(F.col("other")).cast("array<string>"), ",").alias("corners"))


@query("ln_iou", f"""WITH {DUCK_LINES}, {_MOVED}, i AS (SELECT *, least(x2, bx2) - greatest(x1, bx1) AS w,
 least(y2, by2) - greatest(y1, by1) AS h FROM moved)
SELECT product_id, "view", candidate, line_no, CASE WHEN bx2 <= bx1 OR w <= 0 OR h <= 0 THEN 0
 ELSE round(w * h / ((x2 - x1) * (y2 - y1) + (bx2 - bx1) * (by2 - by1) - w * h), 9) END AS iou FROM i""")
def ln_iou(spark, sf_dir):
    return _with_moved(spark, sf_dir).select(
        "product_id", "view", "candidate", "line_no",
        F.round(g.iou(g.box_of(F.col("polygon")), g.box_of(F.col("other"))), 9).alias("iou"))


# Copies of a line in the three variants overlap by 0.8 or more; other lines never meet,
# so the greedy rule keeps one line per place.
_SEQ = "CASE candidate WHEN 'enhanced' THEN 0 WHEN 'original' THEN 1 ELSE 2 END"
_PLACED = f"""{DUCK_LINES}, placed AS (SELECT *, {_SEQ} AS crank,
 row_number() OVER (PARTITION BY product_id, "view", line_no ORDER BY confidence DESC, {_SEQ}) AS rn
 FROM ocr_lines WHERE {_TIDY} <> '')"""


@query("ln_merge_dedup", f"""WITH {_PLACED} SELECT product_id, "view", CAST(line_no AS BIGINT) AS line_no, candidate,
 md5(text) AS text, confidence FROM placed WHERE rn = 1""")
def ln_merge_dedup(spark, sf_dir):
    rank = ev.rank_in(F.col("candidate"), ev.CANDIDATES)
    ordered = ocr_lines(spark, sf_dir).withColumn("seq", rank * F.lit(1 << 40) + F.col("line_no"))
    return ev.merge_lines(ordered, ("product_id", "view"), "seq").select(
        "product_id", "view", F.col("line_no").cast("bigint").alias("line_no"), "candidate",
        F.md5(F.col("text").cast("binary")).alias("text"), "confidence")


# Six lines of a document and their variants drift over each other: a line meets some kept ones by half or
# more and others by less, and a surer line takes a place whose next neighbours then differ. The twin folds
# the lines of a group one by one, as the rule says.
_CHAINS = f"""{DUCK_LINES}, drifting AS (SELECT product_id, "view", line_no // 6 AS lot, {_SEQ} * 1099511627776 + line_no AS seq,
 confidence, CAST(10 + 30 * ((product_id + 5 * line_no + {_SEQ}) % 3) AS DOUBLE) AS x1,
 CAST(3 * (line_no % 6) + {_SEQ} AS DOUBLE) AS y1 FROM ocr_lines),
src AS (SELECT product_id, "view", lot, row_number() OVER (PARTITION BY product_id, "view", lot ORDER BY seq) AS n,
 count(*) OVER (PARTITION BY product_id, "view", lot) AS size,
 {{'pos': seq, 'seq': seq, 'c': confidence, 'x': x1, 'y': y1}} AS l FROM drifting),
fold AS (SELECT product_id, "view", lot, n, size, [l] AS kept FROM src WHERE n = 1
 UNION ALL SELECT product_id, "view", lot, n, size, CASE WHEN hit IS NULL OR hit = 0 THEN list_append(kept, l)
  WHEN l.c > kept[hit].c THEN list_concat(kept[:hit - 1], [{{'pos': kept[hit].pos, 'seq': l.seq, 'c': l.c, 'x': l.x, 'y': l.y}}],
   kept[hit + 1:]) ELSE kept END
 FROM (SELECT f.product_id, f."view", f.lot, s.n, f.size, f.kept, s.l, list_position([
   (200 - abs(e.x - s.l.x)) * greatest(12 - abs(e.y - s.l.y), 0)
   / (4800 - (200 - abs(e.x - s.l.x)) * greatest(12 - abs(e.y - s.l.y), 0)) >= 0.5 FOR e IN f.kept], true) AS hit
  FROM fold f JOIN src s ON s.product_id = f.product_id AND s."view" = f."view" AND s.lot = f.lot AND s.n = f.n + 1))"""


@query("ln_merge_chains", f"""WITH RECURSIVE {_CHAINS} SELECT product_id, "view", lot, e.pos AS position, e.seq AS seq, e.c AS confidence
FROM (SELECT product_id, "view", lot, unnest(kept) AS e FROM fold WHERE n = size)""")
def ln_merge_chains(spark, sf_dir):
    """The merge of lines that overlap in chains: which sightings stand, and by which line."""
    rank, line = ev.rank_in(F.col("candidate"), ev.CANDIDATES), F.col("line_no")
    left = (10 + 30 * ((F.col("product_id") + 5 * line + rank) % 3)).cast("double")
    top = (3 * (line % 6) + rank).cast("double")
    lines = ocr_lines(spark, sf_dir).select(
        "product_id", "view", F.expr("line_no div 6").alias("lot"), (rank * F.lit(1 << 40) + line).alias("seq"), "confidence",
        F.concat(F.lit("Lot "), F.expr("line_no div 6")).alias("text"),
        F.array(F.array(left, top), F.array(left + 200, top + 12)).alias("polygon"))
    return ev.merge_lines(lines, ("product_id", "view"), "seq").select(
        "product_id", "view", "lot", "position", "seq", "confidence")


@query("ln_candidate_union", f"""WITH {_PLACED} SELECT product_id, "view", 'extraction' AS kind, count(*) AS lines,
 round(sum(confidence), 6) AS confidence FROM placed WHERE rn = 1 GROUP BY ALL
UNION ALL SELECT p.product_id, p."view", 'visual', count(*), round(sum(confidence), 6) FROM placed p JOIN (
 SELECT product_id, "view", arg_max(candidate, s * 10 - crank * 1e-6) AS candidate FROM (SELECT product_id, "view", candidate, crank,
  round(avg(confidence) * (1 + 0.1 * count(*)), 9) AS s FROM placed GROUP BY ALL) GROUP BY ALL) b
 ON b.product_id = p.product_id AND b."view" = p."view" AND b.candidate = p.candidate GROUP BY ALL""")
def ln_candidate_union(spark, sf_dir):
    merged = stored(ev.candidate_lines(ocr_lines(spark, sf_dir), united=True), "variant-lines")

    def figures(lines, kind):
        return lines.groupBy("product_id", "view").agg(
            F.lit(kind).alias("kind"), F.count("*").alias("lines"),
            F.round(F.sum("confidence"), 6).alias("confidence"))

    return figures(ev.extraction_lines(merged), "extraction").unionByName(
        figures(ev.visual_lines(merged), "visual"))


@query("ln_candidate_score", f"""WITH {_PLACED} SELECT product_id, "view", candidate, count(*) AS n_lines,
 round(avg(confidence) * (1 + 0.1 * count(*)), 6) AS score FROM placed GROUP BY ALL""")
def ln_candidate_score(spark, sf_dir):
    merged = ev.candidate_lines(ocr_lines(spark, sf_dir))
    return ev.candidate_scores(merged).select(
        "product_id", "view", "candidate", "n_lines", F.round("score", 6).alias("score"))


@query("ln_candidate_best", f"""WITH {DUCK_LINES}, kept AS (SELECT *, {_SEQ} AS crank FROM ocr_lines
 WHERE {_TIDY} <> '' AND product_id % 4 <> 0 AND NOT (product_id % 4 = 1 AND candidate = 'enhanced')),
found AS (SELECT product_id, "view", candidate, crank, n, round(s, 9) AS s FROM (SELECT product_id, "view", candidate, crank, count(*) AS n,
 avg(confidence) * (1 + 0.1 * count(*)) AS s FROM kept GROUP BY ALL)),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY product_id, "view" ORDER BY s DESC, crank) = 1)
SELECT v.product_id, v."view", coalesce(candidate, 'none') AS best_candidate, round(s, 6) AS score, coalesce(n, 0) AS visual_lines
FROM (SELECT DISTINCT product_id, "view" FROM ocr_lines) v LEFT JOIN best b ON b.product_id = v.product_id AND b."view" = v."view" """)
def ln_candidate_best(spark, sf_dir):
    """Each view's strongest variant; every fourth product has no line at all, others lack a variant."""
    lines, part = ocr_lines(spark, sf_dir), F.col("product_id") % 4
    text = F.when((part == 0) | ((part == 1) & (F.col("candidate") == "enhanced")), " ").otherwise(F.col("text"))
    merged = stored(ev.candidate_lines(lines.withColumn("text", text)), "variant-lines")
    return ev.chosen_candidates(lines.select("product_id", "view").distinct(), merged).withColumn(
        "score", F.round("score", 6))


@query("ln_box_rescale", L + """SELECT product_id, "view", candidate, CAST(line_no AS BIGINT) AS line_no,
 CASE WHEN product_id % 5 = 0 THEN x1 ELSE CAST(format('{:.2f}', least(1000.0::DOUBLE + product_id,
  x1 * ((1000.0::DOUBLE + product_id) / 800))) AS DOUBLE) END AS x1,
 CASE WHEN product_id % 5 = 0 THEN y2 ELSE least(300.0::DOUBLE, y2 * 0.5) END AS y2
FROM ocr_lines""")
def ln_box_rescale(spark, sf_dir):
    """Back to original pixels; every fifth product has no known size."""
    lines = ocr_lines(spark, sf_dir)
    wide = F.when(F.col("product_id") % 5 == 0, 0).otherwise(1000 + F.col("product_id"))
    views = lines.select("product_id", "view").distinct().withColumns({
        "processed": F.struct(F.lit(800).alias("width"), F.lit(600).alias("height")),
        "original": F.struct(wide.alias("width"), F.lit(300).alias("height")),
    })
    return ev.rescale_boxes(lines, views).select(
        "product_id", "view", "candidate", F.col("line_no").cast("bigint").alias("line_no"),
        F.col("box")[0].alias("x1"), F.col("box")[3].alias("y2"))


# Each view's photo was resized, turned, both, or turned, resized and fitted; the twin undoes the steps one after
# the other. All numbers are exact in binary.
_BACK = """back AS (SELECT product_id, "view", candidate, CAST(line_no AS BIGINT) AS line_no, product_id % 5 AS kind, x1, y1, x2, y2,
 CAST(128 + product_id % 64 AS DOUBLE) AS w, CAST(1024 + product_id % 512 AS DOUBLE) AS h FROM ocr_lines),
corners AS (SELECT *, unnest([{'c': 1, 'x': x1, 'y': y1}, {'c': 2, 'x': x2, 'y': y2}]) AS p FROM back),
first_undone AS (SELECT * EXCLUDE (p, x1, y1, x2, y2), p.c AS c,
 CASE WHEN kind = 1 THEN greatest(0, least(w - 1, p.x / 0.5)) WHEN kind IN (2, 3) THEN w - 1 - p.y
      WHEN kind = 4 THEN greatest(0, least(2 * w, p.x * (2 * w / 64))) ELSE p.x END AS x,
 CASE WHEN kind = 1 THEN greatest(0, least(h - 1, p.y / 0.5)) WHEN kind IN (2, 3) THEN p.x
      WHEN kind = 4 THEN greatest(0, least(2 * h, p.y * (2 * h / 256))) ELSE p.y END AS y FROM corners),
second_undone AS (SELECT * EXCLUDE (x, y),
 CASE WHEN kind = 3 THEN greatest(0, least(w - 1, x / 0.25)) WHEN kind = 4 THEN greatest(0, least(w - 1, x / 2)) ELSE x END AS x,
 CASE WHEN kind = 3 THEN greatest(0, least(h - 1, y / 0.25)) WHEN kind = 4 THEN greatest(0, least(h - 1, y / 2)) ELSE y END AS y
 FROM first_undone),
third_undone AS (SELECT * EXCLUDE (x, y), CASE WHEN kind = 4 THEN w - 1 - y ELSE x END AS x,
 CASE WHEN kind = 4 THEN x ELSE y END AS y FROM second_undone)"""


@query("ln_box_restore", f"""WITH {DUCK_LINES}, {_BACK} SELECT product_id, "view", candidate, line_no,
 round(min(x), 6) AS x1, round(min(y), 6) AS y1, round(max(x), 6) AS x2, round(max(y), 6) AS y2 FROM third_undone GROUP BY ALL""")
def ln_box_restore(spark, sf_dir):
    """Boxes through every kind of recorded step; each fifth product's photos were read as they are."""
    lines = ocr_lines(spark, sf_dir)
    width = (128 + F.col("product_id") % 64).cast("double")
    height = (1024 + F.col("product_id") % 512).cast("double")

    def step(kind, scale=None, to=(None, None), times=1):
        sides = dict(zip(("to_width", "to_height"), to))
        return F.struct(F.lit(kind).alias("kind"), (width * times).alias("width"), (height * times).alias("height"),
                        F.lit(scale).cast("double").alias("scale"), *[F.lit(v).cast("double").alias(k) for k, v in sides.items()])

    kind = F.col("product_id") % 5
    steps = (F.when(kind == 1, F.array(step("resize", 0.5))).when(kind == 2, F.array(step("turn")))
             .when(kind == 3, F.array(step("resize", 0.25), step("turn")))
             .when(kind == 4, F.array(step("turn"), step("resize", 2.0), step("fit", to=(64, 256), times=2))))
    views = lines.select("product_id", "view").distinct().withColumn("steps", steps)
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    sides = {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}
    return ev.restore_boxes(lines, views).select(
        "product_id", "view", "candidate", F.col("line_no").cast("bigint").alias("line_no"),
        *[F.round(value, 6).alias(name) for name, value in sides.items()])


@query("ln_raw_text", L + """SELECT product_id, md5(string_agg('[' || "view" || '] ' || trim(text), chr(10) ORDER BY
 CASE "view" WHEN 'front' THEN 0 WHEN 'back' THEN 1 ELSE 2 END, line_no)) AS raw_text
FROM ocr_lines WHERE candidate = 'enhanced' AND trim(text) <> '' GROUP BY product_id""")
def ln_raw_text(spark, sf_dir):
    lines = ocr_lines(spark, sf_dir).filter("candidate = 'enhanced'")
    return ev.raw_text(lines).select(
        "product_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


@query("ln_raw_text_merged", L + """SELECT product_id, md5(string_agg('[' || "view" || '] ' || trim(text), chr(10) ORDER BY
 CASE "view" WHEN 'front' THEN 0 WHEN 'back' THEN 1 ELSE 2 END, line_no)) AS raw_text
FROM ocr_lines WHERE candidate = 'enhanced' AND trim(text) <> '' GROUP BY product_id""")
def ln_raw_text_merged(spark, sf_dir):
    """The text of all variants, merged: copies of a line fall together, so it reads like one variant."""
    return ev.raw_text(merged_lines(ocr_lines(spark, sf_dir))).select(
        "product_id", F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


@query("ln_usable_gate", L + """SELECT p.product_id, CASE WHEN r.product_id IS NULL THEN
 'OCR returned no view results. No compliance score was generated.' WHEN NOT r.ok THEN
 'OCR could not read text from the uploaded images. No compliance score was generated.' END AS reason
FROM (SELECT DISTINCT doc_id AS product_id FROM documents) p LEFT JOIN (
 SELECT product_id, bool_or(product_id % 3 <> 0 AND trim(text) <> '') AS ok FROM ocr_lines GROUP BY product_id) r
 ON r.product_id = p.product_id""")
def ln_usable_gate(spark, sf_dir):
    """Products without views, with unreadable views, and readable ones."""
    products = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("product_id")).distinct()
    lines = ocr_lines(spark, sf_dir).withColumn(
        "text", F.when(F.col("product_id") % 3 == 0, " \t").otherwise(F.col("text")))
    ok, quarantine = ev.split_usable(products, lines)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(quarantine)


_UNIQUE = f"""{DUCK_CODES}, uniq AS (SELECT product_id, "view", scan_pass, trim(type) AS type, trim(data) AS data,
 min(position) AS position FROM code_scans WHERE trim(data) <> '' GROUP BY ALL)"""
_PASSED = f"""{_UNIQUE}, passed AS (SELECT * EXCLUDE (pr) FROM (SELECT *, min(pr) OVER (PARTITION BY product_id, "view") AS first_pr
 FROM (SELECT *, CASE scan_pass WHEN 'original' THEN 0 WHEN 'gray' THEN 1 ELSE 2 END AS pr FROM uniq)) WHERE pr = first_pr)"""
_CODE_COLS = 'product_id, "view", scan_pass, type, data, position'


@query("code_unique", f"WITH {_UNIQUE} SELECT {_CODE_COLS} FROM uniq")
def code_unique(spark, sf_dir):
    return ev.unique_codes(code_scans(spark, sf_dir))


@query("code_first_pass", f"WITH {_PASSED} SELECT {_CODE_COLS} FROM passed")
def code_first_pass(spark, sf_dir):
    return ev.select_pass(code_scans(spark, sf_dir)).select(
        "product_id", "view", "scan_pass", "type", "data", "position")


@query("code_verify", f"""WITH {_PASSED}, t AS (SELECT product_id, "view", lower(string_agg(trim(text), ' ' ORDER BY line_no)) AS txt
 FROM ocr_lines WHERE candidate = 'original' GROUP BY ALL)
SELECT p.product_id, p."view", p.type, p.data, CASE WHEN type LIKE 'QR%' THEN 'DECODED'
 WHEN contains(txt, lower(data)) THEN 'LABEL_MATCH' ELSE 'NO_OCR_MATCH' END AS status,
 CASE WHEN type LIKE 'QR%' THEN 'QR payload decoded successfully; external source not verified.'
 WHEN contains(txt, lower(data)) THEN 'Decoded barcode also appears in OCR text.'
 ELSE 'Barcode decoded, but its value was not found in OCR text.' END AS message
FROM passed p LEFT JOIN t ON t.product_id = p.product_id AND t."view" = p."view" """)
def code_verify(spark, sf_dir):
    lines = ocr_lines(spark, sf_dir).filter("candidate = 'original'")
    return ev.verify_codes(ev.select_pass(code_scans(spark, sf_dir)), lines).select(
        "product_id", "view", "type", "data", "status", "message")


@query("code_verify_all", f"""WITH {_PASSED}, t AS (SELECT product_id, "view", lower(string_agg(trim(text), ' ' ORDER BY line_no, trim(text))) AS txt
 FROM ocr_lines GROUP BY ALL), pairs AS (SELECT *, CASE WHEN position % 3 = 0 THEN data || ' ' || data WHEN position % 3 = 1
 THEN ' ' || data || '. ' || data ELSE data END AS read FROM passed)
SELECT p.product_id, p."view", p.type, p.read AS data, p.position, CASE WHEN type LIKE 'QR%' THEN 'DECODED'
 WHEN contains(txt, lower(trim(read))) THEN 'LABEL_MATCH' ELSE 'NO_OCR_MATCH' END AS status
FROM pairs p LEFT JOIN t ON t.product_id = p.product_id AND t."view" = p."view" """)
def code_verify_all(spark, sf_dir):
    """Codes against the lines of all variants; some have blanks, so their text may go over a line end."""
    data, place = F.col("data"), F.col("position") % 3
    codes = ev.select_pass(code_scans(spark, sf_dir)).withColumn("data", F.when(
        place == 0, F.concat(data, F.lit(" "), data)).when(
        place == 1, F.concat(F.lit(" "), data, F.lit(". "), data)).otherwise(data))
    return ev.verify_codes(codes, ocr_lines(spark, sf_dir)).select(
        "product_id", "view", "type", "data", "position", "status")


@query("code_rollup", f"""WITH {_PASSED} SELECT v.product_id, v."view", count(type) FILTER (type LIKE 'QR%') AS qr_codes,
 count(type) FILTER (type NOT LIKE 'QR%') AS barcodes, count(type) AS total_codes
FROM (SELECT DISTINCT product_id, "view" FROM ocr_lines) v LEFT JOIN (SELECT * FROM passed WHERE product_id % 4 <> 0) p
 ON p.product_id = v.product_id AND p."view" = v."view" GROUP BY ALL""")
def code_rollup(spark, sf_dir):
    """Every view counts, also those whose scan brought nothing."""
    codes = code_scans(spark, sf_dir).withColumn(
        "data", F.when(F.col("product_id") % 4 == 0, "").otherwise(F.col("data")))
    views = ocr_lines(spark, sf_dir).select("product_id", "view").distinct()
    return ev.rollup_codes(views, ev.select_pass(codes))


# ---- view merge -------------------------------------------------------------------

_LONG = " UNION ALL ".join(
    f"""SELECT product_id, "view", '{f}' AS field, {f} AS value FROM view_fields WHERE coalesce(trim({f}), '') <> ''"""
    for f in TEXT_FIELDS)
_V = "trim(regexp_replace(lower(value), '\\s+', ' ', 'g'))"
_T = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
# Values and lines are tokenised once each, before they meet.
_WORDS = "list_distinct(regexp_extract_all({}, '[a-z0-9]+'))"
_SCORED = f"""{DUCK_LABEL_LINES}, fv AS MATERIALIZED (SELECT *, {_WORDS.format('v')} AS vw FROM (SELECT *, {_V} AS v FROM ({_LONG}))),
ll AS MATERIALIZED (SELECT *, {_WORDS.format('t')} AS tw FROM (SELECT *, {_T} AS t FROM label_lines WHERE trim(text) <> '')),
scored AS (SELECT f.product_id, f."view", f.field, l.line_no, trim(l.text) AS text,
 l.confidence, l.x1, l.y1, l.x2, l.y2, CASE WHEN contains(t, v) THEN 1.0::DOUBLE WHEN len(vw) = 0 THEN 0
  ELSE len(list_intersect(vw, tw))::DOUBLE / len(vw) END AS sim
 FROM fv f JOIN ll l ON l.product_id = f.product_id AND l."view" = f."view"),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, "view", field ORDER BY sim DESC, confidence DESC, line_no) AS rn
 FROM scored WHERE sim > 0) WHERE rn = 1)"""
_CONF = "CAST(format('{:.3f}', greatest(0, least(1, confidence * (0.7::DOUBLE + 0.3::DOUBLE * sim)))) AS DOUBLE)"


@query("fv_similarity", f"""WITH {_SCORED} SELECT product_id, "view", field, line_no, round(sim, 9) AS similarity FROM scored""")
def fv_similarity(spark, sf_dir):
    """Every filled text field against every line of its view."""
    keys = ["product_id", "view"]
    filled = view_fields(spark, sf_dir).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in TEXT_FIELDS])).alias("f"))
    filled = filled.select(*keys, "f.field", "f.value").filter(tx.has_text(F.col("value")))
    lines = label_lines(spark, sf_dir).filter(tx.has_text(F.col("text")))
    both = vm.with_words(lines, "text").join(vm.with_words(filled, "value"), keys)
    return both.select(*keys, "field", "line_no", F.round(vm.similarity("value", "text"), 9).alias("similarity"))


@query("fv_best_line", f"""WITH {_SCORED} SELECT product_id, "view", field, line_no, text, confidence,
 round(sim, 9) AS similarity FROM best""")
def fv_best_line(spark, sf_dir):
    return vm.best_line(view_fields(spark, sf_dir), label_lines(spark, sf_dir)).select(
        "product_id", "view", "field", "line_no", "text", "confidence",
        F.round("similarity", 9).alias("similarity"))


@query("fv_confidence", f"""WITH {_SCORED} SELECT product_id, "view", field, {_CONF} AS confidence FROM best""")
def fv_confidence(spark, sf_dir):
    maps = vm.field_confidence(view_fields(spark, sf_dir), label_lines(spark, sf_dir))
    return maps.select("product_id", "view", F.explode("field_confidence").alias("field", "confidence"))


_R2 = "CAST(format('{{:.2f}}', {}) AS DOUBLE)"


@query("fv_boxes", f"""WITH {_SCORED} SELECT product_id, "view", field, text, {_CONF} AS confidence,
 CAST(format('{{:.3f}}', sim) AS DOUBLE) AS similarity, confidence AS ocr_confidence,
 {_R2.format('x1')} AS x1, {_R2.format('y1')} AS y1, {_R2.format('x2')} AS x2, {_R2.format('y2')} AS y2, CAST(4 AS BIGINT) AS corners,
 '0deg' AS orientation FROM best""")
def fv_boxes(spark, sf_dir):
    boxes = vm.field_boxes(view_fields(spark, sf_dir), label_lines(spark, sf_dir))
    return boxes.select(
        "product_id", "view", "field", "text", "confidence", "similarity", "ocr_confidence",
        *[F.col("box")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.size("polygon").cast("bigint").alias("corners"), "orientation")


def _pick(field: str, order, default: str = "NULL") -> str:
    text = field not in ("mrp_inclusive_of_taxes", "is_food", "is_cosmetic", "is_electronic", "is_imported", "has_shelf_life")
    parts = [f"max({'nullif(' + field + ', chr(0))' if text else field}) FILTER (\"view\" = '{v}'"
             + (f" AND {field} <> '')" if text else ")") for v in order]
    return f"coalesce({', '.join(parts)}, {default}) AS {field}"


_FSB, _FBS, _BSF = ("front", "side", "back"), ("front", "back", "side"), ("back", "side", "front")
_MERGED = "merged AS (SELECT product_id, " + ", ".join(
    [_pick(f, _FSB) for f in ("brand", "generic_name", "product_name", "net_quantity")]
    + [_pick(f, _FBS) for f in ("mrp", "unit_sale_price", "specific_product")]
    + [_pick("product_type", _FBS, "'general'")]
    + [_pick(f, _FBS, "false") for f in ("mrp_inclusive_of_taxes", "is_food", "is_cosmetic", "is_electronic", "is_imported")]
    + [_pick(f, _BSF) for f in ("manufacturer_address", "packer", "importer", "consumer_care", "mfg_date",
                                "best_before", "use_by", "country_of_origin")]
    + [_pick("has_shelf_life", _BSF, "false")]) + " FROM view_fields GROUP BY product_id)"
_COLS = ", ".join(LABEL_FIELDS)


@query("fv_view_merge", f"WITH {DUCK_VIEWS}, {_MERGED} SELECT product_id, {_COLS} FROM merged")
def fv_view_merge(spark, sf_dir):
    return vm.merge_views(view_fields(spark, sf_dir)).select("product_id", *LABEL_FIELDS)


def _slug(text: str, n: int) -> str:
    return f"nullif(left(trim(regexp_replace(upper({text}), '[^A-Z0-9]+', '_', 'g'), '_'), {n}), '')"


@query("fv_product_id", f"""WITH {DUCK_VIEWS}, s AS (SELECT product_id, "view",
 {_slug("trim(string_split(split_part(brand, ',', 1), 'by')[-1])", 20)} AS b, {_slug('generic_name', 25)} AS n,
 {_slug('net_quantity', 10)} AS q FROM view_fields)
SELECT product_id, "view", coalesce(nullif(concat_ws('_', b, CASE WHEN contains(coalesce(b, ''), n) THEN NULL ELSE n END, q), ''),
 'PRODUCT_20240131_000000') AS slug FROM s""")
def fv_product_id(spark, sf_dir):
    return view_fields(spark, sf_dir).select("product_id", "view", vm.product_id(
        F.col("brand"), F.col("generic_name"), F.col("net_quantity"), F.lit(AS_OF).cast("timestamp"),
    ).alias("slug"))


@query("fv_front_fields", f"""WITH {DUCK_VIEWS} SELECT p.product_id, f.generic_name, f.mrp FROM
 (SELECT DISTINCT product_id FROM view_fields) p LEFT JOIN view_fields f ON f.product_id = p.product_id AND f."view" = 'front'""")
def fv_front_fields(spark, sf_dir):
    return vm.front_fields(view_fields(spark, sf_dir)).select(
        "product_id", F.col("front_fields.generic_name").alias("generic_name"), F.col("front_fields.mrp").alias("mrp"))


@query("inspect_lines")
def inspect_lines_query(spark, sf_dir):
    """The whole way from lines to scored products."""
    lines = label_lines(spark, sf_dir).withColumn("candidate", F.lit("enhanced"))
    return inspect_lines(lines, load_rules(spark), AS_OF).select(
        "job_id", "product_id", "product_type", "score", "is_compliant", "summary",
        F.array_join("missing_fields", ",").alias("missing_fields"))


@query("inspect_products", f"""WITH {DUCK_LINES} SELECT product_id, CASE WHEN bool_or({_TIDY} <> '') THEN 'result'
 ELSE 'OCR could not read text from the uploaded images. No compliance score was generated.' END AS outcome
FROM ocr_lines GROUP BY product_id
UNION ALL SELECT -1 - product_id, 'OCR returned no view results. No compliance score was generated.' FROM
 (SELECT DISTINCT product_id FROM ocr_lines) WHERE product_id % 5 = 0""")
def inspect_products_query(spark, sf_dir):
    """Every product has a result or a reason; some products have no photo at all."""
    lines = ocr_lines(spark, sf_dir)
    known = lines.select("product_id").distinct()
    products = known.unionByName(known.filter("product_id % 5 = 0").select((-1 - F.col("product_id")).alias("product_id")))
    results, unusable = inspect_products(products, lines, load_rules(spark), AS_OF, code_scans(spark, sf_dir))
    return results.select(F.col("job_id").alias("product_id"), F.when(
        F.col("score").isNotNull() & F.col("raw_text").isNotNull(), "result").alias("outcome")).unionByName(
        unusable.select("product_id", F.col("reason").alias("outcome")))
