"""What a converting host knows of tracks: file names, tags and batch results, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.modes import MODES, rate_class
from .container import TAGS


def output_name(path: Column, subsong: Column, extension: str) -> Column:
    """Base name without its extension, "track" where it is empty, the number of a subsong over 0, and the extension."""
    base = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    base = F.when(F.coalesce(base, F.lit("")) == "", "track").otherwise(base)
    return F.concat(base, F.when(subsong > 0, F.concat(F.lit("."), subsong.cast("string"))).otherwise(F.lit("")), F.lit(f".{extension}"))


def first_values(metadata: Column) -> list[Column]:
    """A column for each tag from a map of text lists: the first value or the empty text; of a date four letters."""
    out = []
    for tag, _ in TAGS:
        value = F.coalesce(F.get(metadata["date" if tag == "year" else tag], F.lit(0)), F.lit(""))
        out.append((F.substring(value, 1, 4) if tag == "year" else value).alias(tag))
    return out


def preselected_kbps(rate: Column, channels: Column, configured: Column) -> Column:
    """Of the totals that the rate's class has, the largest up to the configured one, else the smallest."""
    out = F.lit(None).cast("int")
    ch = F.least(F.greatest(channels, F.lit(1)), F.lit(2))
    for k in sorted({m[0] for m in MODES}):
        totals = F.array(*[ch * m[1] for m in MODES if m[0] == k])
        fit = F.array_max(F.filter(totals, lambda t: t <= configured))
        out = F.when(rate_class(rate) == k, F.coalesce(fit, F.array_min(totals))).otherwise(out)
    return out.cast("int")


def batch_result(results: DataFrame, key: str) -> DataFrame:
    """(key, ok, failed, errors) of rows with an error text or null: one failure stops no other."""
    return results.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_sort(F.collect_set("error")).alias("errors"))


def same_tags(left: DataFrame, right: DataFrame, key: str = "file") -> DataFrame:
    """(key, same): whether all tags of the two rows are equal, nulls being equal to each other."""
    tags = [t for t, _ in TAGS]
    other = right.select(F.col(key).alias("__k"), *[F.col(t).alias(f"__{t}") for t in tags])
    same = F.lit(True)
    for t in tags:
        same = same & F.col(t).eqNullSafe(F.col(f"__{t}"))
    return left.join(other, F.col(key) == F.col("__k")).select(key, same.alias("same"))


def progress(spark: SparkSession, group: str) -> tuple[int, int]:
    """(tasks done, tasks known) of the jobs that were started under a job group, while they run; what the session no longer
    keeps counts as nothing."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j is not None for s in j.stageIds}]
    known = [s for s in stages if s is not None]
    return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)


def abort(spark: SparkSession, group: str) -> None:
    """Cancel the jobs of a job group; what they have not written yet is not written."""
    spark.sparkContext.cancelJobGroup(group)
