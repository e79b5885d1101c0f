"""Registry writes and streams over several batches."""

import os
import re

from pyspark.sql import functions as F

from packwise.functions.keys import perhaps_among
from packwise.operators.registry import RESULT_COLUMNS
from packwise.sources import records as rec
from packwise.sources.storage import new_folder
from packwise.streaming import jobs


def test_upsert_touches_only_the_days_of_the_updates(spark, tmp_path):
    rows = spark.range(6).select(
        F.col("id").cast("string").alias("id"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,int(id % 3))").alias("created_at"),
        *[F.lit("old").alias(c) for c in RESULT_COLUMNS])
    path = str(tmp_path / "registry")
    rec.write_records(rows, path)
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("dt=")}
    updates = rec.read_records(spark, path).filter("id = '1'").withColumns({c: F.lit("new") for c in RESULT_COLUMNS})
    rec.upsert_records(spark, path, updates)
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("dt=")}
    assert [d for d in sorted(before) if before[d] != after[d]] == ["dt=2024-01-02"]
    got = rec.read_records(spark, path).select("id", RESULT_COLUMNS[0]).collect()
    assert sorted(map(tuple, got)) == [(str(i), "new" if i == 1 else "old") for i in range(6)]
    assert rec.list_records(rows, None, None, "officer").count() == 6
    assert [r["id"] for r in rec.list_records(rows, None, None, "officer", limit=2).collect()] == ["2", "5"]


def _stream(spark, batches, ddl):
    path = new_folder(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, ddl).selectExpr("*").withColumn(
            "created_at", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_daily_counts_over_batches_and_a_late_row(spark):
    ddl = "created_at string, product_type string, is_compliant boolean"
    batches = [[("2024-01-01 10:00:00", "food", True)], [("2024-01-01 12:00:00", "food", False)],
               [("2024-01-09 12:00:00", "food", True)],
               [("2024-01-09 13:00:00", "food", False)], [("2024-01-01 13:00:00", "food", True)]]
    got = jobs.run_to_table(jobs.daily_stream(_stream(spark, batches, ddl)), "daily", keys=("day", "product_type"))
    assert sorted((str(r["day"]), r["inspections"], r["compliant"]) for r in got.collect()) == [
        ("2024-01-01", 2, 1), ("2024-01-09", 2, 1)]


def test_repeats_in_a_later_batch_are_dropped(spark):
    ddl = "created_at string, inspection_id long"
    batches = [[("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 2)], [("2024-01-01 10:30:00", 1), ("2024-01-01 12:00:00", 3)]]
    got = jobs.run_to_table(jobs.dedup_stream(_stream(spark, batches, ddl)), "unique")
    assert sorted(r["inspection_id"] for r in got.collect()) == [1, 2, 3]


def test_repeats_far_beyond_a_watermark_and_late_first_sightings(spark):
    ddl = "created_at string, inspection_id long, note string"
    batches = [[("2024-01-01 10:00:00", 1, "a"), ("2024-01-01 09:00:00", 1, "b"), ("2024-01-01 11:00:00", 2, "a")],
               [("2024-06-01 10:00:00", 1, "late"), ("2024-06-01 12:00:00", 3, "a"), (None, None, "none")],
               [("2024-01-02 10:00:00", 4, "older than any watermark"), ("2024-12-01 10:00:00", 3, "late"), (None, None, "none again")]]
    got = jobs.run_unique(_stream(spark, batches, ddl), "unique")
    rows = sorted((r["inspection_id"] or 0, r["note"]) for r in got.collect())
    assert rows == [(0, "none"), (1, "b"), (2, "a"), (3, "a"), (4, "older than any watermark")]
    assert got.columns == ["created_at", "inspection_id", "note"]


def test_a_batch_that_runs_again_writes_the_same_rows(spark):
    target = new_folder(spark, "unique")
    rows = [[(1, "2024-01-01"), (2, "2024-01-01")], [(2, "2024-02-01"), (3, "2024-02-01")]]
    frames = [spark.createDataFrame(r, "inspection_id long, created_at string") for r in rows]
    frames[0].limit(0).write.parquet(f"{target}/batch=-1")
    for number in (0, 1, 0, 1):
        jobs.write_unseen(frames[number], number, target, "inspection_id", "created_at")
    got = spark.read.parquet(target).select("inspection_id", "batch").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 0), (3, 1)]


def test_pages_open_the_newest_days_alone(spark, tmp_path):
    rows = [(f"r{i:03}", f"2024-01-{1 + i // 10:02} 0{i % 10 // 4}:00:00", f"user{i % 3}") for i in range(200)]
    rows += [("zz", None, "user0"), ("za", None, "user1")]
    df = spark.createDataFrame(rows, "id string, created_at string, officer_user_id string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    path = str(tmp_path / "registry")
    rec.write_records(df, path)
    every = [r["id"] for r in df.orderBy(F.desc("created_at"), "id").collect()]
    page = rec.page_records(spark, path, 25)
    assert [r["id"] for r in page.collect()] == every[:25]
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", page._jdf.queryExecution().executedPlan().toString())[1]
    assert set(re.findall(r"2024-\d\d-\d\d", filters)) == {"2024-01-20", "2024-01-19", "2024-01-18"}
    got, after = [], None
    while chunk := rec.page_records(spark, path, 47, after).collect():
        got += [r["id"] for r in chunk]
        after = (chunk[-1]["created_at"], chunk[-1]["id"])
    assert got == every
    own = rec.page_records(spark, path, 500, None, "user1", None, "officer").collect()
    assert [r["id"] for r in own] == [i for i in every if dict((r[0], r[2]) for r in rows)[i] == "user1"]


def test_whole_inspection_of_readable_and_unreadable_products(spark):
    from packwise.plans.inspection import inspect_products
    from packwise.sources.rules import load_rules
    text = ["Amul Butter", "Net Qty: 100 g", "MRP Rs. 50 incl. of all taxes", "Manufactured by: Acme Foods, Plot 4, Pune"]
    rows = [(1, "front", "enhanced", n, t, 0.9, [[0.0, 20.0 * n], [90.0, 20.0 * n + 15]]) for n, t in enumerate(text)]
    rows += [(1, "front", "original", n, t, 0.8, [[1.0, 20.0 * n], [91.0, 20.0 * n + 15]]) for n, t in enumerate(text)]
    rows += [(2, "front", "enhanced", 0, "   ", 0.9, None)]
    lines = spark.createDataFrame(rows, "product_id int, view string, candidate string, line_no int, text string, "
                                        "confidence double, polygon array<array<double>>")
    codes = spark.createDataFrame([(1, "front", "original", "EAN13", "plot", 0)],
                                  "product_id int, view string, scan_pass string, type string, data string, position long")
    products = spark.createDataFrame([(1,), (2,), (3,)], "product_id int")
    results, unusable = inspect_products(products, lines, load_rules(spark), "2024-01-31 00:00:00", codes)
    row = results.collect()
    assert len(row) == 1 and row[0]["job_id"] == 1 and row[0]["raw_text"].count("[front]") == len(text)
    assert [c["status"] for c in row[0]["code_scans"]] == ["LABEL_MATCH"]
    assert {b["field"] for b in row[0]["boxes"]} >= {"net_quantity", "mrp"}
    assert sorted((r["product_id"], "no view" in r["reason"]) for r in unusable.collect()) == [(2, False), (3, True)]


def test_newest_folder_by_the_time_of_its_files(spark, tmp_path):
    from packwise.sources import fields_json as fj
    for folder, time, mrp in (("product_b", 2_000_000_000, "2"), ("product_a", 1_999_999_000, "1"), ("product_c", 1_500_000_000, "3")):
        (tmp_path / folder).mkdir()
        for name in ("x.json", "y.json"):
            file = tmp_path / folder / name
            file.write_text(f'{{"product_folder": "{folder}", "mrp": "{mrp}", "brand": "{name}"}}')
            os.utime(file, (time, time - (name == "x.json") * 5))
    read, _ = fj.read_fields(spark, str(tmp_path))
    assert sorted((r["mrp"], r["brand"]) for r in fj.latest_folder(read).collect()) == [("2", "x.json"), ("2", "y.json")]
    assert sorted((r["product_folder"], r["brand"]) for r in fj.latest_per_folder(read).collect()) == [
        (f"product_{x}", "y.json") for x in "abc"]
    assert fj.latest_folder(read.limit(0)).count() == 0


def test_an_upsert_that_stops_between_two_days_is_ended_by_the_next(spark, tmp_path, monkeypatch):
    rows = spark.range(8).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") < 6, F.expr("timestamp'2024-01-01' + make_interval(0,0,0,int(id % 3))")).alias("created_at"),
        *[F.lit("old").alias(c) for c in RESULT_COLUMNS])
    path = str(tmp_path / "registry")
    rec.write_records(rows, path)

    def updates(ids, value):
        found = rec.read_records(spark, path).where(F.col("id").isin(ids)).drop("dt")
        return found.withColumns({c: F.lit(value) for c in RESULT_COLUMNS})

    def values():
        return {r["id"]: r[RESULT_COLUMNS[0]] for r in rec.read_records(spark, path).collect()}

    class Stopped(Exception):
        pass

    finish, calls = rec.finish_upsert, []

    def stops(spark, path):
        """The second time, one of the days is replaced and then the run ends."""
        calls.append(path)
        if len(calls) == 1:
            return finish(spark, path)
        staged = spark.read.json(f"{path}/{rec.NOTE}").first()["staged"]
        spark.read.parquet(staged).where("dt = '2024-01-02'").write.partitionBy("dt").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(path)
        raise Stopped

    monkeypatch.setattr(rec, "finish_upsert", stops)
    try:
        rec.upsert_records(spark, path, updates(["0", "1", "7"], "new"))
    except Stopped:
        pass
    assert values() == {**dict.fromkeys("02345678"[:-1], "old"), "1": "new", "6": "old"}  # half done
    monkeypatch.setattr(rec, "finish_upsert", finish)
    strange = updates(["2"], "newer").unionByName(updates(["3"], "lost").withColumn("id", F.lit("99")))
    unmet = rec.upsert_records(spark, path, strange)
    assert values() == {"0": "new", "1": "new", "2": "newer", "3": "old", "4": "old", "5": "old", "6": "old", "7": "new"}
    assert [r["id"] for r in unmet.collect()] == ["99"]
    assert not any(d.startswith("_") and d != "_SUCCESS" for d in os.listdir(path))


def test_an_upsert_writes_each_record_once_and_moves_the_named_alone(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("1", 1), ("1", 2), ("2", 3), (None, 4), ("3", 5)], "id string, number int").select(
        "id", "number", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,number % 2)").alias("created_at"),
        *[F.lit("old").alias(c) for c in RESULT_COLUMNS])
    path = str(tmp_path / "registry")
    rec.write_records(rows, path)
    found = rec.read_records(spark, path).drop("dt")
    named = found.where("id = '2' or id is null or number = 1").withColumns({c: F.lit("new") for c in RESULT_COLUMNS})
    twice = named.unionByName(named.where("id = '2'").withColumn("summary", F.lit("newer"))).withColumn(
        "id", F.when(F.col("number") == 1, "9").otherwise(F.col("id")))
    finish, staged = rec.finish_upsert, []

    def files(folder):
        return {name for _, _, names in os.walk(folder) for name in names if name.endswith(".parquet")}

    def noted(spark, path):
        staged.append(files(f"{path}/{rec.STAGED}"))
        finish(spark, path)

    monkeypatch.setattr(rec, "finish_upsert", noted)
    unmet = rec.upsert_records(spark, path, twice)
    assert sorted((r["id"] or "", r["number"]) for r in unmet.collect()) == [("", 4), ("9", 1)]
    got = [(r["id"], r["number"], r["summary"]) for r in rec.read_records(spark, path).collect()]
    assert sorted(got, key=repr) == sorted([
        ("1", 1, "old"), ("1", 2, "old"), ("2", 3, "new"), ("2", 3, "newer"), (None, 4, "old"), ("3", 5, "old")], key=repr)
    assert staged[-1] and files(path) == staged[-1]  # the staged files themselves took the days' place
    finish(spark, path)  # nothing is left to be done
    named, others = perhaps_among(spark.range(100_000).toDF("id"), spark.range(50).toDF("id"), "id")
    assert 50 <= named.count() < 200 and others.count() + named.count() == 100_000 and others.where("id < 50").isEmpty()
