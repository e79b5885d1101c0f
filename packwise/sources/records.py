"""The inspection registry: partitioned parquet, listing, append."""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwise.operators.registry import upsert
from packwise.sources.storage import exists, move_folders, remove, stored

#: Folders beside the days; readers skip names of this form.
STAGED, NOTE = "_staged", "_replacing"


def visible_records(records: DataFrame, user_id: str | None, officer_id: str | None, role: str) -> DataFrame:
    """Records a user may see; administrators see all of them."""
    if not user_id or role.strip().lower() == "admin":
        return records
    own = F.col("officer_user_id") == user_id
    if officer_id is not None:
        own = own | (F.col("officer_id") == officer_id)
    return records.filter(own)


def list_records(records: DataFrame, user_id: str | None, officer_id: str | None, role: str,
                 limit: int | None = None) -> DataFrame:
    """Records a user may see, newest first. A page is asked for by ``limit``."""
    ordered = visible_records(records, user_id, officer_id, role).orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def stored_days(records: DataFrame) -> list[date | None]:
    """The days of a stored registry, newest first and the undated last, from the names of its files."""
    names = {unquote(m[1]) for f in records.inputFiles() if (m := re.search("/dt=([^/]+)/", f))}
    days = sorted((date.fromisoformat(n) for n in names if not n.startswith("__")), reverse=True)
    return [*days, *[None for n in names if n.startswith("__")]]


def page_records(spark: SparkSession, path: str, limit: int, after: tuple[datetime | None, str] | None = None,
                 user_id: str | None = None, officer_id: str | None = None, role: str = "admin") -> DataFrame:
    """The next ``limit`` records of a stored registry, newest first, behind the record ``after`` (created_at, id).

    Days are opened newest first, one, then twice as many, and so on, until they fill the page; older days
    aren't read. Records of one time are ordered by id, undated ones come last. Pages don't shift when newer
    records are added, for each is told by the last record of the one before.
    """
    records = read_records(spark, path)
    days, behind = stored_days(records), F.lit(True)
    if after is not None:
        time, last = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        if after[0] is None:
            days, behind = days[-1:], F.col("created_at").isNull() & (F.col("id") > last)
        else:
            first = records.select(F.to_date(time)).first()[0]  # the day as the session's time zone has it
            days = [d for d in days if d is None or d <= first]
            behind = F.col("created_at").isNull() | (F.col("created_at") < time) | (
                (F.col("created_at") == time) & (F.col("id") > last))

    def opened(chosen: list[date | None]) -> DataFrame:
        dated = [d for d in chosen if d is not None]
        within = F.col("dt").isin(dated) if dated else F.lit(False)
        if len(dated) < len(chosen):
            within = within | F.col("dt").isNull()
        return visible_records(records.filter(within), user_id, officer_id, role).filter(behind)

    upto, step, found = 0, 1, 0
    while upto < len(days) and found < limit:
        found += opened(days[upto:upto + step]).limit(limit - found).count()
        upto, step = min(len(days), upto + step), 2 * step
    return opened(days[:upto]).orderBy(F.desc("created_at"), "id").limit(limit)


def write_records(records: DataFrame, path: str) -> None:
    """Append records, one folder per day of creation."""
    records.withColumn("dt", F.to_date("created_at")).write.partitionBy("dt").mode(
        "append"
    ).parquet(path)


def read_records(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Stored records; ``since`` prunes whole days."""
    kept = spark.read.parquet(path)
    return kept if since is None else kept.filter(F.col("dt") >= F.lit(since).cast("date"))


def upsert_records(spark: SparkSession, path: str, updates: DataFrame) -> DataFrame:
    """Replace the result columns of the stored records that ``updates`` names; returns the updates that met none.

    Only the days of the updated records are read and written again; ``updates`` has the
    records' ids and creation times (none for undated ones). The list of days is the one thing that is gathered.

    The new days are written aside as a whole, then a note names them, then their folders take the old ones' place, which
    may be done again any number of times. A run that ends early leaves the note, or nothing at all: the next one (or
    ``finish_upsert``) ends its work first.
    """
    updates = stored(updates, "updates")  # they may be read from the days that are about to be replaced
    finish_upsert(spark, path)
    days = [r[0] for r in updates.select(F.to_date("created_at")).distinct().collect()]
    within = F.col("dt").isin([d for d in days if d is not None])
    touched = read_records(spark, path).filter(within | F.col("dt").isNull() if None in days else within)
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}"
    upsert(touched, updates).write.partitionBy("dt").parquet(staged)
    missing = stored(updates.select("id").join(touched.select("id"), "id", "left_anti").select(
        F.col("id").alias("_id")), "unmet-ids")  # ids alone move, and mostly none is left
    unmet = stored(updates.join(missing, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), "unmet-updates")
    spark.createDataFrame([(staged,)], "staged string").coalesce(1).write.mode("overwrite").json(f"{path}/{NOTE}")
    finish_upsert(spark, path)
    return unmet


def finish_upsert(spark: SparkSession, path: str) -> None:
    """Puts the days that a note names into their place, if there is one."""
    if not exists(spark, f"{path}/{NOTE}"):
        return
    for row in spark.read.schema("staged string").json(f"{path}/{NOTE}").collect():
        move_folders(spark, row["staged"], path, "dt=")
    remove(spark, f"{path}/{NOTE}")
    remove(spark, f"{path}/{STAGED}")
