"""Spatial deduplication against a brute-force fold, view merge, ids, image metrics."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from packwise.operators import evidence as ev
from packwise.operators import images as im
from packwise.operators import replies as rp
from packwise.operators import view_merge as vm
from packwise.schemas import LABEL_FIELDS


def brute(lines):
    """Every line against every kept line, in order."""
    kept = []
    for seq, text, confidence, box in sorted(lines):
        if not text.strip():
            continue
        key = " ".join(text.lower().split())
        for k in kept:
            if k["key"] == key and box and k["box"] and ev._overlap(box, k["box"]) >= 0.5:
                if confidence > k["confidence"]:
                    k.update(seq=seq, confidence=confidence, box=box)
                break
        else:
            kept.append({"pos": seq, "seq": seq, "key": key, "confidence": confidence, "box": box})
    return sorted((k["pos"], k["seq"]) for k in kept)


def test_merge_equals_brute_force(spark):
    """Jittered boxes form chains, hot copies and separate lines."""
    rng = random.Random(7)
    rows, plain = [], []
    for seq in range(400):
        text = rng.choice(["MRP", "mrp ", "Net  wt", " "])
        x, y = rng.choice([0, 4, 9, 14, 300]), rng.choice([0, 3, 6, 11, 16, 90])
        box = (float(x), float(y), float(x + 40), float(y + 20)) if rng.random() < 0.9 else None
        confidence = rng.randint(50, 60) / 100
        plain.append((seq, text, confidence, box))
        polygon = box and [[box[0], box[1]], [box[2], box[1]], [box[2], box[3]], [box[0], box[3]]]
        rows.append((1, "front", seq, text, confidence, polygon))
    df = spark.createDataFrame(
        rows, "product_id int, view string, line_no int, text string, confidence double, "
        "polygon array<array<double>>")
    got = ev.merge_lines(df, ("product_id", "view"), "line_no")
    assert sorted((r["position"], r["line_no"]) for r in got.collect()) == brute(plain)


def test_view_merge_keeps_false_and_default(spark):
    base = {f: None for f in LABEL_FIELDS}
    front = {**base, "product_type": "general", "is_food": False, "mrp": "", "brand": "A"}
    back = {**base, "product_type": "food", "is_food": True, "mrp": "20", "brand": "B"}
    ddl = "product_id int, view string, field_confidence map<string,double>, " + ", ".join(
        f"{f} {'boolean' if f.startswith('is_') or f in ('has_shelf_life', 'mrp_inclusive_of_taxes') else 'string'}"
        for f in LABEL_FIELDS)
    rows = [(1, v, {"mrp": c, "brand": c}, *[d[f] for f in LABEL_FIELDS])
            for v, c, d in (("front", 0.9, front), ("back", 0.4, back))]
    out = vm.merge_views(spark.createDataFrame(rows, ddl)).first()
    assert (out["product_type"], out["is_food"], out["mrp"], out["brand"]) == ("general", False, "20", "A")
    assert out["field_confidence"] == {"mrp": 0.4, "brand": 0.9} and out["has_shelf_life"] is False


def test_product_ids(spark):
    rows = [("Baby Dove, HUL", "Soap", "100 g"), ("Made by Amul", "amul", None), (None, None, "")]
    df = spark.createDataFrame(rows, "b string, n string, q string")
    got = [r[0] for r in df.select(vm.product_id(
        F.col("b"), F.col("n"), F.col("q"), F.lit("2024-01-31").cast("timestamp"))).collect()]
    assert got == ["DOVE_SOAP_100_G", "AMUL", "PRODUCT_20240131_000000"]


def test_replies(spark):
    rows = [('<think>{x</think>{"mrp": 20, "brand": null}',), ("[1]",), ('say {"mrp": "5"} ok',), ("",)]
    good, bad = rp.parse_replies(spark.createDataFrame(rows, "reply string"), "reply")
    assert [r["parsed"] for r in good.collect()] == [{"mrp": "20", "brand": None}, {"mrp": "5"}]
    assert bad.count() == 2
    filled = rp.fill_defaults(good).first()
    assert filled["brand"] is None and filled["product_type"] == "general"


def test_image_quality_of_a_flat_and_a_striped_image(spark):
    flat = np.full((90, 100, 3), 100, np.uint8)
    striped = np.zeros((90, 100, 3), np.uint8)
    striped[:, ::2] = 200
    rows = [(n, 90, 100, 3, bytearray(a.tobytes())) for n, a in (("flat", flat), ("striped", striped))]
    df = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary")
    out = {r["origin"]: r for r in im.quality(df).collect()}
    assert (out["flat"]["brightness"], out["flat"]["contrast"], out["flat"]["blur_score"]) == (100.0, 0.0, 0.0)
    assert out["striped"]["brightness"] == 100.0 and out["striped"]["contrast"] == 100.0
    assert out["striped"]["blur_score"] == 160000.0 and out["striped"]["is_noisy"]


def test_merge_of_null_keys_boxes_without_polygon_and_timestamps(spark):
    """Null keys are keys, a corner list stands in for a polygon, columns come back as they were."""
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    near = [[1.0, 0.0], [11.0, 0.0], [11.0, 10.0], [1.0, 10.0]]
    rows = [(None, 0, "MRP", 0.5, square, None), (None, 1, "mrp", 0.9, near, None), (None, 2, "MRP", 0.7, None, None),
            ("back", 0, "MRP", 0.6, None, [0.0, 0.0, 9.0, 9.0]), ("back", 1, "MRP", 0.6, None, [0.0, 0.0, 9.0, 9.0]),
            ("back", 2, "MRP", 0.6, [], [100.0, 0.0, 109.0, 9.0])]
    df = spark.createDataFrame(
        rows, "view string, line_no int, text string, confidence double, polygon array<array<double>>, box array<double>"
    ).withColumn("seen", F.expr("timestamp'2024-01-31 10:00:00.123456'"))
    got = ev.merge_lines(df, ("view",), "line_no")
    assert sorted((r["view"] or "", r["line_no"], r["position"]) for r in got.collect()) == [
        ("", 1, 0), ("", 2, 2), ("back", 0, 0), ("back", 2, 2)]
    assert got.where("seen <> timestamp'2024-01-31 10:00:00.123456'").count() == 0 and got.columns == [*df.columns, "position"]


def test_merge_of_one_hot_text_over_many_batches(spark):
    """A repeating junk line with drifting boxes, in Arrow batches of a few rows."""
    rng = random.Random(11)
    plain, rows = [], []
    for seq in range(1500):
        x, y = rng.randint(0, 60), rng.randint(0, 900)
        box = (float(x), float(y), float(x + rng.choice((20, 40))), float(y + rng.choice((8, 12, 20))))
        confidence = rng.randint(1, 99) / 100
        plain.append((seq, "junk", confidence, box))
        rows.append((1, "front", seq, "junk", confidence, [[box[0], box[1]], [box[2], box[3]]]))
    df = spark.createDataFrame(
        rows, "product_id int, view string, line_no int, text string, confidence double, polygon array<array<double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = ev.merge_lines(df, ("product_id", "view"), "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["position"], r["line_no"]) for r in got) == brute(plain)


LINE = "product_id int, view string, line_no int, text string, confidence double, polygon array<array<double>>"


def corner_rows(boxes):
    return [(1, "front", seq, text, confidence, box and [[box[0], box[1]], [box[2], box[3]]])
            for seq, text, confidence, box in boxes]


def test_merge_of_hot_groups_cut_into_bands(spark, monkeypatch):
    """Chains, boxes apart on either axis, huge, tiny and missing boxes; the same rows as in one piece."""
    rng = random.Random(5)
    boxes = []
    for seq in range(3000):
        x, y = rng.choice((0, 200, 400, 401, 407, 900)) + rng.randint(0, 25), 40 * rng.randint(0, 12) + rng.randint(0, 6)
        box = (float(x), float(y), float(x + rng.choice((30, 60))), float(y + rng.choice((12, 20))))
        if rng.random() < 0.02:
            box = rng.choice(((0.0, 0.0, 1000.0, 600.0), (5.0, 5.0, 5.001, 5.001), None, (1.0, 1.0, 1.0, 9.0),
                              (0.0, 0.0, float("inf"), 5.0), (float("nan"), 0.0, 4.0, 5.0)))
        boxes.append((seq, rng.choice(("junk", "junk", "JUNK ", "other", f"rare {seq % 50}")), rng.randint(1, 99) / 100, box))
    df = spark.createDataFrame(corner_rows(boxes), LINE)
    monkeypatch.setattr(ev, "HOT_SHARE", 0.01)
    usable = [b if b[3] and b[3][2] > b[3][0] and b[3][2] < 1e30 else (*b[:3], None) for b in boxes]
    for hot in (None, 100, 1):
        got = ev.merge_lines(df, ("product_id", "view"), "line_no", hot).collect()
        assert sorted((r["position"], r["line_no"]) for r in got) == brute(usable)
    key = F.xxhash64(F.lit(1), F.lower(F.trim("text")))
    ready = df.withColumns({"_a": key, "_b": key, "_order": F.col("line_no").cast("long")})
    assert sorted(ev._large_groups(ready, 100)) == sorted(
        r[0] for r in ready.where("lower(trim(text)) in ('junk', 'other')").select("_a").distinct().collect())
    bands = ev._banded(ready.where("lower(trim(text)) = 'junk'")).groupBy("_a").count().collect()
    assert len(bands) > 20 and max(r["count"] for r in bands) < 500


def test_merge_of_boxes_side_by_side_is_linear():
    import time

    def fold(boxes):
        kept, begin = ev._Kept(), time.perf_counter()
        for i, box in enumerate(boxes):
            kept.add(i, 0.5, box, i)
        return len(kept.lines), time.perf_counter() - begin

    row = [(12.0 * i, 3.0, 12.0 * i + 10, 23.0) for i in range(8000)]
    assert fold(row)[0] == 8000 and fold(row)[1] < 2
    column = [(3.0, 12.0 * i, 23.0, 12.0 * i + 10) for i in range(8000)]
    assert fold(column)[0] == 8000 and fold(column)[1] < 2


def test_inner_thirds_of_boxes_that_may_meet_touch():
    rng = random.Random(9)
    met = 0
    for _ in range(60_000):
        a = (0.0, 0.0, rng.uniform(5, 10), rng.uniform(5, 10))
        x, y = rng.uniform(-4, 4), rng.uniform(-4, 4)
        b = (x, y, x + rng.uniform(4, 14), y + rng.uniform(4, 14))
        if ev._overlap(a, b) >= 0.5:
            met += 1
            for low, high in ((0, 2), (1, 3)):
                reach = ev.INNER * (a[high] - a[low] + b[high] - b[low])
                assert abs((a[low] + a[high]) / 2 - (b[low] + b[high]) / 2) <= reach
    assert met > 1000


def test_merge_of_points_without_two_coordinates_and_null_points(spark):
    rows = [(1, "front", 0, "a", 0.5, [[0.0, 0.0], [10.0, 10.0]]), (1, "front", 1, "a", 0.6, [[0.0, 0.0], None, [10.0, 10.0]]),
            (1, "front", 2, "a", 0.7, [None, None]), (1, "front", 3, "a", 0.7, [[None, 0.0], [10.0, 9.0], [0.0, None]]),
            (1, "front", 4, "a", 0.1, []), (1, "front", 5, "a", 0.1, None)]
    got = ev.merge_lines(spark.createDataFrame(rows, LINE), ("product_id", "view"), "line_no", None)
    assert sorted((r["position"], r["line_no"]) for r in got.collect()) == [(0, 3), (2, 2), (4, 4), (5, 5)]


def test_rescale_keeps_a_box_without_polygon(spark):
    rows = [("front", None, [10.0, 10.0, 20.0, 20.0]), ("front", [[1.0, 1.0], [3.0, 5.0]], [0.0, 0.0, 9.0, 9.0]),
            ("back", None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "view string, polygon array<array<double>>, box array<double>").withColumn(
        "product_id", F.lit(1))
    size = "struct<width:int,height:int>"
    views = spark.createDataFrame([(1, "front", (100, 100), (200, 300)), (1, "back", None, None)],
                                  f"product_id int, view string, processed {size}, original {size}")
    got = ev.rescale_boxes(df, views).select("view", "box").collect()
    assert sorted((r["view"], r["box"]) for r in got) == [
        ("back", [1.0, 2.0, 3.0, 4.0]), ("front", [2.0, 3.0, 6.0, 15.0]), ("front", [20.0, 30.0, 40.0, 60.0])]


def test_replies_whole_or_not_at_all(spark):
    rows = ['{"a":1,"a":2}', '{"a":1} tail {"b":2}', 'see {"a": "x } y"} there', '[{"a":1}]', "{'a':1}", '{"a":1}]']
    good, bad = rp.parse_replies(spark.createDataFrame([(r,) for r in rows], "reply string"), "reply")
    assert {r["reply"]: r["parsed"] for r in good.collect()} == {
        rows[0]: {"a": "2"}, rows[2]: {"a": "x } y"}, rows[5]: {"a": "1"}}
    assert bad.count() == 3


def test_a_made_reply_is_named_once(spark):
    """What makes the reply isn't repeated by the steps that read it, nor put into the condition on them."""
    rows = [('{"a":1,"b":{"c":', "2}}"), ("<think>{", '}</think> so {"a":null} it is'), ("\u3000", " "), (None, "{}"), ('"{', '}"')]
    made = spark.createDataFrame(rows, "head string, tail string").select(F.concat("head", "tail").alias("reply"))
    good, bad = rp.parse_replies(made, "reply")
    for frame in (good, bad, rp.fill_defaults(good)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("concat(head") <= 1 and len(plan) < 30_000
    assert [r["parsed"] for r in good.collect()] == [{"a": "1", "b": '{"c":2}'}, {"a": None}]
    assert [r["reason"] for r in bad.collect()] == ["empty content", "empty content", "no JSON object"]


def test_rollup_of_a_view_with_two_errors(spark):
    manifest = spark.createDataFrame([(1, "front"), (1, "back")], "product_id int, view string")
    views = spark.createDataFrame([(1, "front", "blurred"), (1, "front", "absent"), (1, "back", None)],
                                  "product_id int, view string, error string")
    row = im.batch_rollup(manifest, views).first()
    assert (row["num_images"], row["failed"], row["errors"]) == (2, 1, {"front": "absent"})


def test_unreadable_field_files_are_quarantined(spark, tmp_path):
    from packwise.sources import fields_json as fj
    (tmp_path / "a.json").write_text('{"mrp": "20", "is_imported": "true"}\nnot json {\n')
    good, bad = fj.read_fields(spark, str(tmp_path))
    assert [(r["mrp"], r["is_imported"]) for r in good.collect()] == [("20", True)]
    assert [r["record"] for r in bad.collect()] == ["not json {"] and bad.first()["source_file"].endswith("a.json")


def test_best_line_against_brute_force(spark):
    """Ties in similarity and confidence, tiny confidence differences, large and repeated line numbers, empty values."""
    import re

    rng = random.Random(8)
    vocabulary = ["net", "wt", "100", "g", "mrp", "rs", "20", "\u00e9t\u00e9", "best", "before"]
    fields, lines = [], []
    for product in range(60):
        values = {f: rng.choice([None, "", " ", "!!", " ".join(rng.choices(vocabulary, k=rng.randint(1, 4)))])
                  for f in vm.TEXT_FIELDS}
        fields.append((product, "front", *[values[f] for f in vm.TEXT_FIELDS]))
        for n in range(rng.randint(0, 9)):
            sure = rng.choice([0.5, 0.5, 0.5 + 2 ** -53, 1e-9, 0.99, 95.0, 0.0, None])
            text = rng.choice(["", "!! ", " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))).upper()])
            lines.append((product, "front", rng.choice([n, n, 3, (2 << 40) + n, -n]), text, sure))
    kinds = ", ".join(f"{f} string" for f in vm.TEXT_FIELDS)
    got = vm.best_line(spark.createDataFrame(fields, f"product_id int, view string, {kinds}"), spark.createDataFrame(
        lines, "product_id int, view string, line_no long, text string, confidence double"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan

    def split(text):
        return set(re.findall("[a-z0-9]+", text))

    expected = []
    for product, view, *values in fields:
        for field, value in zip(vm.TEXT_FIELDS, values):
            key, found = " ".join((value or "").lower().split()), []
            for p, _, n, text, sure in lines:
                line = " ".join(text.lower().split())
                if p != product or not line or not sure or not key:
                    continue
                same = 1.0 if key in line else len(split(key) & split(line)) / len(split(key)) if split(key) else 0.0
                if same > 0:
                    found.append((-same, -sure, n, text.strip()))
            if found:
                same, sure, n, text = min(found)
                expected.append((product, view, field, n, text, -sure, -same))
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 100


def test_way_back_equals_step_by_step(spark):
    """Random chains of steps, clipped points, steps that lack what they need."""
    from packwise.functions import geometry as g

    def undo(point, step):
        kind, w, h, scale, tw, th = step
        x, y = point
        if kind == "resize" and w and scale:
            return min(max(x / scale, 0), w - 1), min(max(y / scale, 0), h - 1)
        if kind == "turn" and w:
            return w - 1 - y, x
        if kind == "fit" and w and tw:
            return min(max(x * (w / tw), 0), w), min(max(y * (h / th), 0), h)
        return x, y

    rng = random.Random(6)
    rows = []
    for i in range(200):
        steps = [(rng.choice(("resize", "turn", "fit", "other")), rng.choice((100.0, 64.0, None)), 50.0,
                  rng.choice((0.5, 2.0, 0.3, None)), rng.choice((40.0, None)), 80.0) for _ in range(rng.randint(0, 5))]
        points = [[rng.uniform(-20, 150), rng.uniform(-20, 150)] for _ in range(3)] + [[1.0]]
        rows.append((i, rng.choice([steps, steps, None]) if i else None, points))
    df = spark.createDataFrame(rows, f"i int, steps {g.STEPS}, polygon array<array<double>>")
    for i, mapped in df.select("i", g.mapped_back(F.col("polygon"), g.way_back(F.col("steps")))).collect():
        expected = [tuple(p) for p in rows[i][2][:3]]
        for step in reversed(rows[i][1] or []):
            expected = [undo(p, step) for p in expected]
        assert np.allclose(mapped, expected)
    lines = spark.createDataFrame([(1, "front", None, [1.0, 2.0, 5.0, 4.0]), (2, "front", [[1.0, 2.0]], None)],
                                  "product_id int, view string, polygon array<array<double>>, box array<double>")
    views = spark.createDataFrame([(1, "front", [("turn", 10.0, 20.0, None, None, None)])],
                                  f"product_id int, view string, steps {g.STEPS}")
    got = {r["product_id"]: r for r in ev.restore_boxes(lines, views).collect()}
    assert got[1]["box"] == [5.0, 1.0, 7.0, 5.0] and got[2]["polygon"] == [[1.0, 2.0]]


def test_codes_in_a_view_text_that_is_never_put_together(spark):
    """Values over line ends, at ends of cut lines, in empty lines, of views without lines; QR codes, nulls, blanks."""
    rng = random.Random(12)
    lines, codes = [], []
    for product in range(40):
        own = [" ".join(rng.choices(["ab", "AB c", "c", "", "abcabc", "\u00e9", "8901234567890"], k=rng.randint(0, 3)))
               for _ in range(rng.randint(0, 6))]
        lines += [(product, "front", n * 10 % 7, rng.choice([text, text, f"  {text}\t", None])) for n, text in enumerate(own)]
        for place in range(25):
            words = rng.choices(["ab", "c", "bc", "a", "\u00c9", "abcabc", "8901234567890", ""], k=rng.randint(1, 5))
            codes.append((product, "front", place, rng.choice(["EAN13", "EAN13", "EAN13", "QRCODE", None]),
                          rng.choice([" ".join(words), "".join(words), None, " "])))
    got = ev.verify_codes(
        spark.createDataFrame(codes, "product_id int, view string, position int, type string, data string"),
        spark.createDataFrame(lines, "product_id int, view string, line_no int, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == plan.count("specifiedwindowframe(RowFrame, 1,")
    seen = set()
    for r in got.collect():
        text = " ".join(t for _, t in sorted((n, (t or "").strip()) for p, _, n, t in lines if p == r["product_id"])).lower()
        value = (r["data"] or "").strip().lower()
        expected = "DECODED" if (r["type"] or "").startswith("QR") else (
            "LABEL_MATCH" if value and value in text else "NO_OCR_MATCH")
        assert r["status"] == expected and r["message"] == ev.VERIFICATION[expected]
        seen.add((expected, " " in value))
    assert len(seen) == 6 and got.count() == len(codes)


def test_patterns_wait_for_a_word_they_need(spark):
    """Plain searches before the patterns leave out nothing that these find, in odd letters and blanks too."""
    from packwise.functions import text as tx
    from packwise.operators import extraction as ex
    texts = [
        "Net Qty: 5 Kılograms m . r . p Rs 20", "NET 3 pıeces", "2 Kg", "7 l", "٤٥ ml", "a2 g", "QTУ 1 g", "quantity-2 g",
        "MAXIMUM  RETAIL PRİCE: ₹ 12.50 ıncluſıve of all TAXES", "mrp only ınr 9", "M R P 7", "incl.of all taxes", "taxes ıncluded",
        "Mfd.by A Foods cuſtomer care", "packed  by B lic 2", "PKD 1/2/24 mfg:03/2025 date of pacKing 4 days", "Manufactured on 1/24",
        "b.b. 12 months from packing uſe by 1/25", "bb 3 days", "BEST before end 2/26", "Expıry 2/26", "because 5/25 exp 3/26", "unit ſale price Rs. 2 per kg",
        "rſ 3/g", "₹ 4 / ml", "ınr.5/l", "Generic Name: Tea Bags", "made ın India", "Country of Orıgin - China", "orİgin X",
        "ſhelf  life", "valid for ever", "a.b+c@x-y.in, +91 9876543210", "x@@y.com 6123456789", "chocolate oil", "ſoap soap", "", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    t, plain = F.col("t"), lambda patterns, group=1, text=None: tx.collapse_found(F.coalesce(*[
        tx.extract(F.col("t") if text is None else text, re.sub(r"^\(\?iU\)\(\?=(?:\\d|\[.*?\]|.)\)", "(?iU)", p), group) for p in patterns]))
    date = r"\s*[:.\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}[/-]\d{2,4}|\d+\s*(?:days?|months?|years?)(?:\s+from\s+(?:mfd|manufacturing|packing))?)"
    dates = {n: [f"(?iU)(?:{'|'.join(labels)}){date}"] for n, labels in (
        ("mfg_date", ex.MFG_LABELS), ("best_before", ex.BEST_BEFORE_LABELS), ("use_by", ex.USE_BY_LABELS))}
    want = {
        "net_quantity": ex.normalize_quantity(plain(ex.QUANTITY_PATTERNS, text=tx.collapse(t))), "mrp": plain(ex.MRP_PATTERNS, text=tx.collapse(t)),
        "unit_sale_price": plain(ex.UNIT_PRICE_PATTERNS, 0), "manufacturer_address": plain(ex.MAKER_PATTERNS),
        "country_of_origin": plain(ex.ORIGIN_PATTERNS), "mrp_inclusive_of_taxes": tx.matches_any(t, ex.TAX_WORDING),
        "mrp_declaration_detected": tx.matches_any(t, ex.MRP_WORDING), "product_type": ex.classify(t)["type"],
        "generic_name": ex.generic_name(t), "consumer_care": ex.consumer_care(t), **{n: plain(p) for n, p in dates.items()}}
    found = ex.fields_of_text(df, "t")
    assert sorted(map(tuple, found.select("n", *want).collect())) == sorted(map(tuple, df.select("n", *want.values()).collect()))
    for name, value in want.items():
        assert found.where(F.col(name).cast("string") != "false").count(), name
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_folded") > len(ex.BRANDS) + 20 and "RLIKE juice" not in plan
