"""Policy documents and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETENTION = "table string, kind string, years double, grounds string"
#: Decisions, scores and their inputs are kept at least so many years.
LEAST_YEARS = {"decision": 8.0}


def documents(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows of policy documents, one JSON object or array a file, read by Spark's reader.

    Invalid rows carry ``problems``: missing fields, or text that is no JSON.
    """
    raw = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    problems = F.array_compact(F.array(F.when(F.col("_bad").isNotNull(), "not_json"), *[F.when(F.col("_bad").isNull() & F.col(f).isNull(), f"{f}_missing") for f in required]))
    rows = raw.withColumn("problems", problems)
    return rows.filter(F.size("problems") == 0).drop("problems", "_bad"), rows.filter(F.size("problems") > 0).drop("_bad")


def too_short(years: Column, kind: Column) -> Column:
    """Whether a retention rule keeps its kind of table for less than it must."""
    least = F.create_map(*[x for k, v in LEAST_YEARS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(years < F.element_at(least, kind), F.lit(False))


def write_report(rows: DataFrame, path: str) -> None:
    """A report, a few rows of totals, as one JSON file by Spark's writer."""
    rows.coalesce(1).write.mode("overwrite").json(path)
