"""What moves and what is asked for twice: plans of steps that grew faster than their input."""

import re

import pytest
from pyspark.sql import functions as F

from packwise.operators import evidence as ev
from packwise.operators import extraction as ex
from packwise.operators import view_merge as vm
from packwise.functions import text as tx
from packwise.schemas import TEXT_FIELDS
from workload.inputs import code_scans


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _moves(df):
    """The keys of every shuffle of a plan, as column names."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [tuple(re.findall(r"([A-Za-z_]+)#", keys)) for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


def test_patterns_are_asked_once(spark):
    text = spark.createDataFrame([("Net Qty: 5 kilograms  MRP Rs. 20.00 Made in  India",)], "t string")
    for found, patterns, value in (
            (ex.net_quantity(F.col("t")), ex.QUANTITY_PATTERNS, "5 kg"), (ex.mrp(F.col("t")), ex.MRP_PATTERNS, "20.00"),
            (ex.country(F.col("t")), ex.ORIGIN_PATTERNS, "India")):
        df = text.select(found.alias("found"))
        assert df.first()["found"] == value
        # a found value is compared with the empty string, hence twice
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2 * len(patterns)


def test_brands_in_odd_letters(spark):
    """The plain search before a pattern leaves out nothing that the pattern finds."""
    texts = ["a VİM b", "vım", "ſurf", "maſala Kinley", "surfing", "Clinic  Plus", "CLINIC PLUS", "ẞ Tide"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = F.lit(None).cast("string")
    for name in reversed(ex.BRANDS):
        hit = F.when(F.col("t").rlike(rf"{ex.FLAGS}\b{name}\b"), name.title()).otherwise(hit)
    rows = df.select(ex.brand(F.col("t")).alias("own"), hit.alias("plain")).collect()
    assert [r["own"] for r in rows] == [r["plain"] for r in rows]
    assert [r["own"] for r in rows][:4] == ["Vim", "Vim", "Surf", "Kinley"]


def _views(spark):
    fields = spark.createDataFrame(
        [(1, "front", "Amul", "5 kg"), (1, "back", None, "7 g"), (2, "front", "Tata", "")],
        "product_id long, view string, brand string, net_quantity string")
    fields = fields.withColumns({f: F.lit(None).cast("string") for f in TEXT_FIELDS if f not in fields.columns})
    lines = spark.createDataFrame(
        [(1, "front", 0, "AMUL  Gold", 0.9, [[0.0, 0.0], [4.0, 2.0]]), (1, "front", 1, "net 5 kg", 0.8, [[0.0]]),
         (1, "back", 0, "7 g", 0.7, None), (2, "front", 0, "Tata salt", 0.9, [[1.0, 1.0], [2.0, 5.0]])],
        "product_id long, view string, line_no long, text string, confidence double, polygon array<array<double>>")
    return fields, lines


def test_evidence_stays_with_its_view(spark, no_broadcast):
    found = vm.field_confidence(*_views(spark))
    moves = _moves(found)
    assert moves and set(moves) == {("product_id", "view")}
    assert len(moves) <= 4
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {
        (1, "front"): {"brand": 0.9, "net_quantity": 0.8}, (1, "back"): {"net_quantity": 0.7}, (2, "front"): {"brand": 0.9}}


def test_boxes_only_where_there_is_geometry(spark):
    rows = vm.field_boxes(*_views(spark)).select("product_id", "field", "box").collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [(1, "brand", [0.0, 0.0, 4.0, 2.0]), (2, "brand", [1.0, 1.0, 2.0, 5.0])]


def test_words_are_found_before_the_join(spark):
    fields, lines = _views(spark)
    both = vm.with_words(lines, "text").join(vm.with_words(fields.where("brand is not null"), "brand"), ["product_id", "view"])
    rows = both.select("product_id", "line_no", vm.similarity("brand", "text").alias("s")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0)]
    odd = spark.createDataFrame([("a-b aéc",), ("",), (None,), ("--",)], "k string")
    assert [r[0] for r in odd.select(vm.words(F.col("k"))).collect()] == [["a", "b", "c"], [], None, []]


def _codes(spark):
    return spark.createDataFrame([
        (1, "front", "gray", "QR", "x", 5), (1, "front", "gray", "QR", " x　", 3), (1, "front", "original", "QR", "  ", 0),
        (1, "front", "equalised", "QR", "y", 1), (1, "back", "later", "E", "z", 2), (1, "back", "best", "E", "z", 4),
        (1, "back", None, "E", "n", 4), (None, "back", "gray", "E", "q", 4)],
        "product_id long, view string, scan_pass string, type string, data string, position long")


def test_words_of_code_scans_are_divided_once(spark, tmp_path):
    spark.createDataFrame([(4, "a b\nc"), (5, ""), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scans = code_scans(spark, str(tmp_path))
    rows = scans.select("product_id", "view", "type", "data", "position").collect()
    own = [(1, "back", "QRCODE", "8901234567890", 0), (1, "back", "QRCODE", "8901234567890", 1),
           (1, "back", " EAN13 ", "8901234567890", 100000), (1, "side", "QRCODE", "8901234567890", 0)]
    assert sorted(map(tuple, rows)) == sorted(own * 3)
    plan = scans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode([[enhanced") < plan.index("posexplode(split(text")  # below the variants


def test_stripping_plain_blanks_needs_no_search(spark):
    texts = ["", " ", "  a b ", "a", " a", "a\t ", " \u3000a", "\u00e9 ", " \u00e9", "\u00e9", "\x1c~ ", " ! ", "\u2003", "\x01 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(tx.strip(F.col("t")).alias("s"), F.btrim("t", F.lit(tx.SPACE_CHARACTERS)).alias("plain"),
                     tx.strips_to_text(F.col("t")).alias("left")).collect()
    assert [r["s"] for r in rows] == [r["plain"] for r in rows]
    assert [r["left"] for r in rows] == [None if t is None else r["plain"] != "" for t, r in zip(texts, rows)]
    plan = df.select(tx.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(t" in plan.replace("btrim(", "")  # plain blanks go without the list of all white space


def test_codes_move_twice(spark, no_broadcast):
    passed = ev.select_pass(_codes(spark))
    assert len(_moves(passed)) == 2 and "Join" not in passed._jdf.queryExecution().executedPlan().toString()
    rows = passed.select("product_id", "view", "scan_pass", "data", "position").collect()
    assert sorted(map(tuple, rows)) == [(1, "back", "best", "z", 4), (1, "front", "gray", "x", 3)]


def test_verified_codes_are_computed_once(spark):
    lines = spark.createDataFrame([(1, "back", 0, "a Z b")], "product_id long, view string, line_no long, text string")
    verified = ev.verify_codes(ev.select_pass(_codes(spark)), lines)
    assert any("/codes-" in f for f in verified.inputFiles())
    assert {r["data"]: r["status"] for r in verified.collect()} == {"z": "LABEL_MATCH", "x": "DECODED"}


def test_united_variants_move_once(spark):
    """Both merges in one move give what they give one after the other."""
    import random
    draw = random.Random(3)
    rows = []
    for n in range(3000):
        x, y = draw.randrange(12) * 4.0, draw.randrange(40 if n % 2 else 2000) * 3.0
        rows.append((n % 7 if n % 50 else None, draw.choice(["front", "back"]), draw.choice([*ev.CANDIDATES, "other", None]), n // 3,
                     draw.choice(["A  b", "a b", "c", " ", None]), draw.choice([0.5, 0.7, 0.9, None]),
                     [[x, y], [x + 20, y + 10]] if n % 9 else None))
    lines = spark.createDataFrame(rows, "product_id long, view string, candidate string, line_no long, text string, "
                                        "confidence double, polygon array<array<double>>")

    def plain(df):
        return sorted(map(repr, df.select(lines.columns).collect()))

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for hot, batch in ((None, "10000"), (50, "10000"), (None, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            apart = ev.candidate_lines(lines, hot=hot)
            united = ev.candidate_lines(lines, hot=hot, united=True)
            assert plain(united) == plain(apart)
            assert plain(ev.extraction_lines(united)) == plain(ev.extraction_lines(apart, hot=hot))
            assert 0 < ev.extraction_lines(united).count() < united.count()
            assert plain(ev.visual_lines(united)) == plain(ev.visual_lines(apart))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    merged = ev.extraction_lines(ev.candidate_lines(lines, hot=None, united=True))
    assert _moves(merged) == [("_a", "_b")]


def test_codes_move_with_their_first_pass_alone(spark):
    """A code moves with the first pass that has it, not with each, and QR codes move no more; which are left is as before."""
    passes = ["gray", "original", "equalised", "odd", "queer", None]
    rows = [(p, v, passes[(p * 7 + k * k) % 6], ("QRCODE", " EAN13 ", None)[k % 3], (f"w{k % 4} x", f"w{k}", " ")[k % 3 if k else 2], p * 100 + k)
            for p in range(40) for v in ("front", "back", None) for k in range(p % 9)]
    codes = spark.createDataFrame(rows, "product_id long, view string, scan_pass string, type string, data string, position long")
    rank = {n: i for i, n in enumerate(ev.SCAN_PASSES)}
    first, want = {}, {}
    for p, v, s, t, d, n in rows:
        if v and s and d.strip():
            place = (rank.get(s, len(rank)), s)
            first[p, v] = min(first.get((p, v), place), place)
            key = (p, v, s, (t or "").strip(), d.strip())
            want[key] = min(want.get(key, n), n)
    want = sorted((*k, n) for k, n in want.items() if first[k[:2]][1] == k[2])
    chosen = ev.select_pass(codes)
    assert sorted(map(tuple, chosen.select("product_id", "view", "scan_pass", "type", "data", "position").collect())) == want
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    grouped = re.findall(r"Aggregate \[([^]]*)\]", plan)
    assert len(grouped) == 1 and "scan_pass" not in grouped[0] and "WindowGroupLimit" in plan  # some go before the second move
    lines = spark.createDataFrame([(p, "front", 0, "W1 and w4 w0") for p in range(40)], "product_id long, view string, line_no int, text string")
    verified = ev.verify_codes(chosen, lines)
    assert sorted(map(tuple, verified.select(*chosen.columns).collect())) == sorted(map(tuple, chosen.collect()))
    told = {"DECODED": lambda t, d, v: t.startswith("QR"), "LABEL_MATCH": lambda t, d, v: v == "front" and d in "w1 and w4 w0",
            "NO_OCR_MATCH": lambda t, d, v: True}
    for r in verified.collect():
        assert r["status"] == next(k for k, f in told.items() if f(r["type"], r["data"], r["view"]))
    assert {r["status"] for r in verified.collect()} == set(told)
    assert "Union" in verified._jdf.queryExecution().optimizedPlan().toString()
