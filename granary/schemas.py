"""Entity schemas and row checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCOUNT_MONTH = "account_id bigint, snapshot date, month_index int, months_on_book int, dpd int, balance bigint"
FEATURE_VALUE = "entity bigint, event_ts timestamp, created_ts timestamp, value double"
VELOCITY_EVENT = "application_id bigint, key string, dimension string, event_time timestamp, ingest_time timestamp"

ACCOUNT_MONTH_RULES: dict[str, Column | str] = {
    "snapshot is a month end": "snapshot = last_day(snapshot)",
    "months on book are not negative": "months_on_book >= 0",
    "dpd is not negative": "dpd is null or dpd >= 0",
}
FEATURE_VALUE_RULES = {"created at or after the event": "created_ts >= event_ts"}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per broken rule and row: ``rule`` and the row's columns."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return df.withColumn("rule", F.explode(broken))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1")


def require(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``df``, failing at run time on the first row that breaks a rule."""
    return reduce(lambda d, r: d.filter(F.when(F.coalesce(F.expr(r[1]), F.lit(False)), True).otherwise(F.raise_error(F.lit(f"rule broken: {r[0]}")))), rules.items(), df)
