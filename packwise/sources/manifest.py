"""Upload manifests: which files were sent for which views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwise.schemas import VIEWS

# Size limit and messages.
MAX_BYTES = 15 * 1024 * 1024
NO_VIEW = "Upload at least one of front, back, or side."
BAD_NAMES = "view_names must contain unique front/back/side entries"


def validate_manifest(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Errors per job from its file rows (job_id, view, size_bytes, mime).

    Counting runs in two partial aggregates, so a job with many rows is reduced before the
    shuffle and no job is collected.
    """
    named = F.col("view").isin(*VIEWS)
    per_view = files.groupBy("job_id", "view").agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce("size_bytes", F.lit(0)) == 0).alias("empty"),
        F.count_if(F.col("size_bytes") > MAX_BYTES).alias("large"),
        F.count_if((F.col("mime") != "") & ~F.col("mime").startswith("image/")).alias("other"),
    )

    def message(count: str, text: str):
        return F.when(
            named & (F.col(count) > 0), F.concat(F.lit("The "), F.col("view"), F.lit(text))
        )

    per_job = per_view.groupBy("job_id").agg(
        F.count_if(~F.coalesce(named, F.lit(False)) | (F.col("n") > 1)).alias("bad_names"),
        F.sum("n").alias("files"),
        # At most one entry per valid view name and kind of message.
        F.collect_set(message("empty", " image is empty. Choose another file.")).alias("e1"),
        F.collect_set(message("large", " image is larger than 15 MB.")).alias("e2"),
        F.collect_set(message("other", " file must be an image.")).alias("e3"),
    )
    errors = F.concat(
        F.when(F.coalesce("files", F.lit(0)) == 0, F.array(F.lit(NO_VIEW))).otherwise(F.array()),
        F.when(F.coalesce("bad_names", F.lit(0)) > 0, F.array(F.lit(BAD_NAMES))).otherwise(F.array()),
        *[F.coalesce(F.array_sort(c), F.array()) for c in ("e1", "e2", "e3")],
    )
    return jobs.join(per_job, "job_id", "left").select(
        *jobs.columns, F.coalesce("files", F.lit(0)).alias("files"), errors.alias("errors")
    )
