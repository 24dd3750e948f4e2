"""Queues of fraud cases and alerts: closing, precision, completeness, labels, deadlines, rate limits, replay."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Pending, Ratified, read
from granary.operators.governance import reasons


def closed(cases: DataFrame, dispositions: DataFrame, taxonomy: dict[str, str]) -> DataFrame:
    """Cases with the disposition that closes each, and why others do not.

    cases: case_id, application_id, signal, opened. dispositions: case_id, code,
    analyst, at. ``taxonomy`` names the outcome of each code: confirmed,
    cleared or inconclusive. The earliest sound disposition closes a case; a
    disposition with an unknown code or without an analyst closes nothing, and
    ``refused`` counts those and the ones that came later.
    """
    known = F.create_map(*[F.lit(x) for kv in sorted(taxonomy.items()) for x in kv]) if taxonomy else F.create_map().cast("map<string,string>")
    sound = F.coalesce(F.trim("analyst") != "", F.lit(False)) & known[F.col("code")].isNotNull()
    d = dispositions.select(F.col("case_id").alias("id_"), "at", "analyst", "code", known[F.col("code")].alias("outcome"), sound.alias("sound"))
    first = F.min(F.when(F.col("sound"), F.struct("at", "code", "analyst", "outcome")))
    d = d.groupBy("id_").agg(first.alias("d"), (F.count("*") - F.coalesce(F.sum(F.col("sound").cast("int")), F.lit(0)).cast("bigint") + F.greatest(F.sum(F.col("sound").cast("int")) - 1, F.lit(0))).alias("refused"))
    j = cases.join(d, cases["case_id"] == d["id_"], "left")
    return j.select(*cases.columns, F.col("d.at").alias("closed"), F.col("d.code").alias("code"), F.col("d.outcome").alias("outcome"), F.coalesce("refused", F.lit(0)).alias("refused"))


def signal_precision(queue: DataFrame) -> DataFrame:
    """Per signal: cases, closed ones, and the confirmed share of these; null without any."""
    n = lambda c: F.count(F.when(c, 1))
    g = queue.groupBy("signal").agg(F.count("*").alias("cases"), n(F.col("outcome").isNotNull()).alias("closed"), n(F.col("outcome") == "confirmed").alias("confirmed"))
    return g.select("signal", "cases", "closed", (F.col("confirmed") / F.when(F.col("closed") > 0, F.col("closed"))).alias("precision"))


def completeness(queue: DataFrame) -> DataFrame:
    """One row: cases, open ones, and the closed share; null without cases."""
    n, open_ = F.count("*"), F.count(F.when(F.col("outcome").isNull(), 1))
    return queue.agg(n.alias("cases"), open_.alias("open"), ((n - open_) / F.when(n > 0, n)).alias("completeness"))


def training_labels(queue: DataFrame, ratified: bool | Pending | Ratified) -> DataFrame:
    """(application_id, label) of the conclusive cases; inconclusive ones are left out, not clean. The taxonomy must be ratified."""
    if not read(ratified):
        raise ValueError("the taxonomy of dispositions has not been ratified")
    return queue.filter(F.col("outcome").isin("confirmed", "cleared")).select("application_id", (F.col("outcome") == "confirmed").cast("int").alias("label"))


def undisposed(alerts: DataFrame, dispositions: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts that nobody has disposed of."""
    return alerts.join(dispositions.select(key).distinct(), key, "left_anti")


def step_up_friction(rows: DataFrame, label: str = "label", stepped_up: str = "stepped_up") -> DataFrame:
    """Share of the good customers that were sent through verification; null without any."""
    good = F.when(F.col(label) == 0, F.col(stepped_up).cast("double"))
    return rows.agg(F.count(good).alias("goods"), F.avg(good).alias("friction"))


def fraud_evaluation(rows: DataFrame, rate: float, order: list[Column], label: str = "label", score: str = "score", stepped_up: str | None = None) -> DataFrame:
    """One row: rows, frauds, average precision, precision and recall at an alert rate, and step-up friction."""
    from granary.operators import metrics as M

    top = M.alert_rate(rows, rate, order, label).select("precision", "recall")
    one = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("frauds")).crossJoin(F.broadcast(M.average_precision(M.by_score(rows, score, label)))).crossJoin(F.broadcast(top))
    if stepped_up is None:
        return one.withColumn("friction", F.lit(None).cast("double"))
    return one.crossJoin(F.broadcast(step_up_friction(rows, label, stepped_up).select("friction")))


def rate_limited(calls: DataFrame, most: int, seconds: int, key: str = "session", at: str = "at") -> DataFrame:
    """Calls with ``allowed``: fewer than ``most`` allowed calls of the session lie in the ``seconds`` before.

    A refused call is not counted, so each verdict rests on those before it: a
    session is one group, in the order of time. Calls without a session are an error.
    """
    checked = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", F.raise_error(F.lit("a rate limit needs a session")).cast("boolean")).otherwise(True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable")
        seen: list = []
        out = []
        for t in pdf[at]:
            seen = [x for x in seen if (t - x).total_seconds() < seconds]
            out.append(len(seen) < most)
            if out[-1]:
                seen.append(t)
        return pdf.assign(allowed=out)

    given = calls.filter(checked)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", allowed boolean"
    return given.groupBy(key).applyInPandas(run, schema)


def spot_audit(entries: DataFrame, replay: Callable[[DataFrame], DataFrame], size: int, seed: str = "audit", key: str = "id", outcome: str = "outcome") -> DataFrame:
    """One row: a keyed sample of ``size`` logged decisions, how many a replay repeats exactly, and that share.

    ``replay`` gives (key, outcome) for the sampled entries.
    """
    drawn = entries.withColumn("draw_", F.sha2(F.concat_ws("/", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("draw_", key).limit(size).drop("draw_")
    again = replay(drawn).select(F.col(key).alias("key_"), F.col(outcome).alias("again_"))
    j = drawn.join(again, drawn[key] == again["key_"], "left")
    same = F.count(F.when(F.col(outcome).eqNullSafe(F.col("again_")) & F.col("key_").isNotNull(), 1))
    return j.agg(F.count("*").alias("sampled"), same.alias("matched"), (same / F.when(F.count("*") > 0, F.count("*"))).alias("match_rate"))


def firing(signals: dict[str, tuple[str, bool, Column]], family: str | None = None) -> Column:
    """Names of the active signals (of a family) that fire; ``signals``: name -> (family, active, condition). Null does not fire."""
    kept = {n: c for n, (f, active, c) in signals.items() if active and family in (None, f)}
    return reasons(kept) if kept else F.array().cast("array<string>")
