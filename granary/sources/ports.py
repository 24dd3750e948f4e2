"""Readers by port, sinks of designs and models, and policies from YAML or JSON files."""

from __future__ import annotations

import json
import pathlib
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Reader(Protocol):
    """A source by name; ``track`` says where its rows come from."""

    track: str

    def records(self, source: str) -> DataFrame: ...


@dataclass
class InMemory:
    """Rows given in the program: source -> (rows, schema)."""

    spark: SparkSession
    sources: dict[str, tuple[list, str]]
    track: str = "memory"

    def records(self, source: str) -> DataFrame:
        rows, schema = self.sources[source]
        return self.spark.createDataFrame(rows, schema).withColumn("track", F.lit(self.track))


@dataclass
class Tables:
    """Tables of the session's catalog, or Parquet folders under a root."""

    spark: SparkSession
    root: str | None = None
    names: dict[str, str] = field(default_factory=dict)
    track: str = "lakehouse"

    def records(self, source: str) -> DataFrame:
        name = self.names.get(source, source)
        rows = self.spark.table(name) if self.root is None else self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return rows.withColumn("track", F.lit(self.track))


def scenes(observations: DataFrame, plot: Any, start: str, end: str) -> DataFrame:
    """A plot's observations between two days, both included."""
    return observations.filter((F.col("plot") == F.lit(plot)) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def monthly_weather(readings: DataFrame) -> DataFrame:
    """(cell, month, total) from readings (cell, day, amount)."""
    return readings.groupBy("cell", F.trunc("day", "month").alias("month")).agg(F.sum("amount").alias("total"))


def latest(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """A keyed store after a write: of the rows of a key the one with the greatest version."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    whole = F.struct(*[F.col(c) for c in both.columns])
    return both.groupBy(F.col(key).alias("key_")).agg(F.max_by(whole, F.col(version)).alias("row")).select("row.*")


def applications(rows: DataFrame, key: str, label: str, decided_at: str, vintage: str) -> DataFrame:
    """Rows of an extract as application records with the vendor's label: application_id, decided_at, vintage, vendor_label, features (map of the other columns)."""
    others = [c for c in rows.columns if c not in (key, label)]
    features = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]) if others else F.create_map().cast("map<string,string>")
    return rows.select(F.col(key).cast("string").alias("application_id"), F.lit(decided_at).cast("date").alias("decided_at"), F.lit(vintage).alias("vintage"), F.col(label).alias("vendor_label"), features.alias("features"))


def profile(outcomes: DataFrame, label: str = "label") -> DataFrame:
    """(measure, value, n): rows, and how often each label occurs, nulls as censored."""
    counts = outcomes.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("censored")).alias("value")).agg(F.count("*").alias("n"))
    return counts.select(F.lit("label").alias("measure"), "value", "n").unionByName(outcomes.agg(F.count("*").alias("n")).select(F.lit("rows").alias("measure"), F.lit("all").alias("value"), "n"))


def joined_extract(transactions: DataFrame, identity: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Transactions cut to some columns, with the identity rows that some of them have; identity columns are named by their place where names differ in form."""
    named = identity.toDF(*[c.replace("-", "_") for c in identity.columns])
    return transactions.select(key, *[c for c in columns if c != key]).join(named, key, "left")


def aligned(design: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a reference design, in its order; missing ones and nulls are 0."""
    return design.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) if c in design.columns else F.lit(0).alias(c) for c in columns])


def write_design(design: DataFrame, path: str) -> None:
    design.write.mode("overwrite").csv(path, header=True)


def save_model(model: dict[str, Any], path: str) -> None:
    """Coefficients as JSON, sorted, so that equal models are equal files."""
    pathlib.Path(path).write_text(json.dumps(model, sort_keys=True, indent=1))


def load_model(path: str) -> dict[str, Any]:
    return json.loads(pathlib.Path(path).read_text())


def policy(path: str) -> Any:
    """A policy document in YAML (where its library is installed) or JSON."""
    text = pathlib.Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


#: What a declaration of a source must say.
DECLARED = ("id", "kind", "mechanism", "owner", "contains_pii", "retention", "point_in_time_safe")


def declaration_problems(doc: Any, name: str) -> list[str]:
    """What is wrong with one declaration; placeholders count as missing."""
    if not isinstance(doc, dict):
        return [f"{name}: not a mapping"]
    blank = lambda v: v is None or (isinstance(v, str) and v.strip().lower() in ("", "tbd", "todo", "unknown", "n/a"))
    out = [f"{name}: {f} is missing" for f in DECLARED if blank(doc.get(f))]
    if doc.get("contains_pii") and not doc.get("lawful_basis"):
        out.append(f"{name}: personal data without a lawful basis")
    if doc.get("point_in_time_safe") and not doc.get("event_time"):
        out.append(f"{name}: safe in time without a column of event time")
    return out


def registry(directory: str) -> tuple[list[dict], list[str]]:
    """All declarations of a folder, and what is wrong with them, repeated ids included."""
    found, problems = [], []
    for p in sorted(pathlib.Path(directory).glob("*.yaml")) + sorted(pathlib.Path(directory).glob("*.json")):
        doc = policy(str(p))
        bad = declaration_problems(doc, p.name)
        problems += bad
        if not bad:
            found.append(doc)
    ids = [d["id"] for d in found]
    problems += [f"{i}: declared more than once" for i in sorted({i for i in ids if ids.count(i) > 1})]
    return found, problems


def policy_rows(spark: SparkSession, path: str, root: str, schema: str) -> DataFrame:
    """The list under ``root`` of a policy document as a table: retention rules, bands, reason codes."""
    return spark.createDataFrame([tuple(r.get(f.split(" ")[0]) for f in (x.strip() for x in schema.split(","))) for r in policy(path)[root]], schema)
