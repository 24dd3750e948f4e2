"""Readers and sinks: delimited performance extracts, headed CSV, the chained decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.credit import clipped

#: Fields of a row of the monthly performance extract, and the places of those in use.
ARITY = 113
PLACES = {
    "loan_id": 1, "period": 2, "channel": 3, "original_rate": 7, "current_rate": 8, "original_upb": 9, "current_upb": 11, "term": 12, "originated": 13,
    "age": 15, "ltv": 19, "dti": 22, "score": 23, "delinquency": 39, "zero_balance_code": 43, "zero_balance_date": 44,
}
CREDIT_LOSS = ("02", "03", "09", "15")


def performance_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Named, trimmed fields of a pipe-delimited extract without a header. Strict: a row of another width stops the read; else it is skipped."""
    lines = spark.read.text(path).select(F.split("value", r"\|", -1).alias("f"))
    whole = F.size("f") == ARITY
    kept = lines.filter(F.when(whole, True).otherwise(F.raise_error(F.lit(f"a row does not have {ARITY} fields"))) if strict else whole)
    return kept.select(*[F.trim(F.col("f")[i]).alias(n) for n, i in PLACES.items()])


def typed_performance(rows: DataFrame) -> DataFrame:
    """Dates, days past due (null where unknown) and minor units."""
    month = lambda c: F.when(F.col(c).rlike("^[0-9]{6}$"), F.try_to_timestamp(F.col(c), F.lit("MMyyyy")).cast("date"))
    dpd = F.when(F.col("delinquency").rlike("^[0-9]+$"), F.col("delinquency").cast("int") * 30)
    upb = F.coalesce(F.bround(F.expr("try_cast(current_upb as double)") * 100).cast("bigint"), F.lit(0))
    return rows.select("loan_id", month("period").alias("period"), month("originated").alias("originated"), dpd.alias("dpd"), upb.alias("balance"), F.when(F.col("zero_balance_code") != "", F.col("zero_balance_code")).alias("code"))


def loan_outcomes(rows: DataFrame, months: int = 12) -> DataFrame:
    """One row per loan: months seen and unknown, worst days past due inside the window, disposition, and a label or null if censored."""
    inside = (F.col("period") >= F.col("originated")) & (F.col("period") < F.add_months("originated", months))
    end = rows.agg(F.max("period").alias("extract_end"))
    g = rows.groupBy("loan_id").agg(
        F.min("originated").alias("originated"), F.count(F.when(inside, 1)).alias("months"), F.count(F.when(inside & F.col("dpd").isNull(), 1)).alias("unknown"),
        F.max(F.when(inside, F.col("dpd"))).alias("max_dpd"), F.max_by("code", F.when(F.col("code").isNotNull(), F.col("period"))).alias("code"),
        F.max(F.when(inside & F.col("code").isNotNull(), F.lit(1))).alias("ended"),
    ).crossJoin(F.broadcast(end))
    bad = F.coalesce(F.col("max_dpd") >= 90, F.lit(False)) | F.coalesce((F.col("ended") == 1) & F.col("code").isin(*CREDIT_LOSS), F.lit(False))
    censored = F.col("max_dpd").isNull() | (F.col("ended").isNull() & (F.add_months("originated", months) > F.add_months("extract_end", 1)))
    label = F.when(bad, "BAD").when(censored, None).when(F.col("max_dpd") >= 30, "INDETERMINATE").otherwise("GOOD")
    return g.select("loan_id", "months", "unknown", "max_dpd", "code", label.alias("label"))


def verify_levels(rows: DataFrame, allowed: dict[str, list[str]]) -> None:
    """Raises unless the columns hold only the allowed levels, or if there are no rows."""
    seen = rows.agg(F.count("*").alias("n"), *[F.array_except(F.collect_set(c), F.array(*map(F.lit, v))).alias(c) for c, v in allowed.items()]).first()
    if not seen["n"]:
        raise ValueError("the extract is empty")
    wrong = {c: seen[c] for c in allowed if seen[c]}
    if wrong:
        raise ValueError(f"unknown levels: {wrong}")


def headed_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header; the required columns must be in it."""
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def one_hot(df: DataFrame, numeric: dict[str, tuple[float, float]], categorical: list[str]) -> DataFrame:
    """Clipped numbers with missing flags, and one column per level of each category; levels come from one pass."""
    levels = df.agg(*[F.sort_array(F.collect_set(F.nullif(F.trim(c), F.lit("")))).alias(c) for c in categorical]).first() if categorical else {}
    out: list[Column] = []
    for c, (low, high) in numeric.items():
        x = F.expr(f"try_cast(`{c}` as double)")
        x = F.when(~F.isnan(x), x)
        out += [F.coalesce(clipped(x, low, high), F.lit((low + high) / 2)).alias(c), x.isNull().cast("double").alias(f"{c}_missing")]
    for c in categorical:
        out += [F.coalesce(F.trim(c) == v, F.lit(False)).cast("double").alias(f"{c}={v}") for v in levels[c]]
    return df.select(*out)


def chained(records: DataFrame, order: str, body: str) -> DataFrame:
    """Records with the hash of their predecessor in their log: prev and hash. Each log (column log) is a chain, so it is one ordered group."""
    import hashlib

    import pandas as pd

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        prev, prevs, hashes = "", [], []
        for text in pdf[body]:
            prevs.append(prev)
            prev = hashlib.sha256((prev + text).encode()).hexdigest()
            hashes.append(prev)
        return pd.DataFrame({"log": pdf["log"].to_list(), order: pdf[order].to_numpy(), body: pdf[body].to_list(), "prev": prevs, "hash": hashes})

    kind = records.schema[order].dataType.simpleString()
    return records.select("log", order, body).groupBy("log").applyInPandas(link, f"log string, {order} {kind}, {body} string, prev string, hash string")


def breaks(log: DataFrame, order: str, body: str) -> DataFrame:
    """Per log the first record whose hash or link does not hold; needs no chain, as each record carries both."""
    w = Window.partitionBy("log").orderBy(order)
    good = (F.col("hash") == F.sha2(F.concat("prev", body), 256)) & (F.col("prev") == F.coalesce(F.lag("hash").over(w), F.lit("")))
    return log.withColumn("good", good).filter(~F.col("good")).groupBy("log").agg(F.min(order).alias("first_break"))
