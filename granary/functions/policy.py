"""Column expressions and driver-side rules that apply policies: screens, windows, scenarios, fingerprints."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import Pending, Ratified, read
from granary.functions.credit import expit, logit


def screen_iv(iv: Column) -> Column:
    """drop below 0.02, investigate above 0.5 (too good to be true), else pass; null stays null."""
    return F.when(iv < 0.02, "drop").when(iv > 0.5, "investigate").when(iv.isNotNull(), "pass")


def calibrator(n: Column, positives: Column) -> Column:
    """Platt where a sample is too small for steps: under 1,000 rows or 100 positives."""
    return F.when((n < 1000) | (positives < 100), "platt").otherwise("isotonic")


def outcome_window(start: Column, months: int = 12) -> Column:
    """struct(start, end): whole months from the start, clamped to the month's length."""
    return F.struct(start.alias("start"), F.add_months(start, months).alias("end"))


def observation_point(scoring: Column, decided: Column, snapshot: Column) -> Column:
    """The decision's day for applications; for behaviour the snapshot, which must be a month's last day."""
    whole = F.when(snapshot == F.last_day(snapshot), snapshot).otherwise(F.raise_error(F.lit("a behavioural snapshot must be a month end")).cast("date"))
    return F.when(scoring == "application", decided).when(scoring == "behavioural", whole)


def vendor_or_observed(provenance: Column, observed: Column, vendor: Column) -> Column:
    """The label that a row's provenance names; other provenances have none."""
    return F.when(provenance == "observed", observed).when(provenance == "vendor", vendor)


def breached(raised: Column, disposed: Column, now: Column, hours: float | Pending | Ratified) -> Column:
    """Whether an alert took, or has been open, longer than its hours."""
    return F.unix_seconds(F.coalesce(disposed, now)) - F.unix_seconds(raised) > read(hours) * 3600


def fresh(computed: Column, as_of: Column, seconds: int = 300) -> Column:
    return F.unix_seconds(computed) - F.unix_seconds(as_of) <= seconds


def publication_lag(observed: Column, ingested: Column) -> Column:
    return F.datediff(ingested, observed)


def expected_ingests(start: Column, end: Column, revisit: int) -> Column:
    """Acquisitions due from start to end, both included."""
    return (F.floor(F.datediff(end, start) / revisit) + 1).cast("int")


def stressed(rate: Column, coefficients: dict[str, float], scenario: str, scenarios: dict[str, dict[str, float]] | Pending | Ratified) -> Column:
    """A rate moved, on the log-odds scale, by the difference of a ratified scenario's factors from the baseline's."""
    paths = read(scenarios)
    for name in (scenario, "baseline"):
        if name not in paths:
            raise KeyError(f"no ratified scenario {name!r}")
    shift = sum(c * (paths[scenario][f] - paths["baseline"][f]) for f, c in coefficients.items())
    return expit(logit(rate) + F.lit(float(shift)))


def two_stage_lgd(cure: Column | Pending, no_cure: Column) -> Column:
    """(1 - probability of cure) times the loss without cure. Without a ratified cure model there is no such figure."""
    return (1 - read(cure)) * no_cure


def blended(take_up: Column, value: Column, weight: float | Pending | Ratified) -> Column:
    """A bandit's reward: take-up and value in ratified proportions."""
    w = read(weight)
    return w * take_up + (1 - w) * value


def gini_uplift(baseline: Column, with_features: Column, out_of_time: Column, seasons: Column, least: int | Pending | Ratified) -> Column:
    """struct(points, counts): gain in points; it counts only out of time and over enough seasons."""
    return F.struct(((with_features - baseline) * 100).alias("points"), (out_of_time & (seasons >= read(least))).alias("counts"))


def complexity_earned(baseline: Column, challenger: Column, n_baseline: Column, n_challenger: Column, points: float = 5.0) -> Column:
    """Whether a challenger's macro F1 (in points) beats the baseline's by enough; null unless both saw the same number of rows."""
    return F.when(n_baseline == n_challenger, challenger - baseline >= points)


def tranche_release(*_: object, rule: Pending = Pending("tranche release rule", "credit policy")) -> Column:
    """Refuses: no rule has been ratified."""
    return read(rule)


def content_hash(*columns: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the columns as canonical JSON; nulls are kept."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, 16)


def config_hash(config: dict[str, Any]) -> str:
    """SHA-256 of a configuration as sorted JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def fingerprint(definitions: dict[str, Any]) -> str:
    """Short hash that two environments compare to know that they share definitions."""
    return config_hash(definitions)[:16]


def validated(schema: dict[str, Any], arguments: dict[str, Any]) -> None:
    """Raises unless the arguments of a call fit its schema: required, properties (type, enum, minimum, maximum), and no others."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
    properties = schema.get("properties", {})
    if missing := [r for r in schema.get("required", ()) if r not in arguments]:
        raise ValueError(f"missing arguments: {missing}")
    if unknown := sorted(set(arguments) - set(properties)):
        raise ValueError(f"unknown arguments: {unknown}")
    for name, value in arguments.items():
        rule = properties[name]
        kind = kinds.get(rule.get("type", ""), object)
        if not isinstance(value, kind) or (isinstance(value, bool) and rule.get("type") in ("integer", "number")):
            raise ValueError(f"{name}: not of type {rule['type']}")
        if "enum" in rule and value not in rule["enum"]:
            raise ValueError(f"{name}: not one of {rule['enum']}")
        if "minimum" in rule and value < rule["minimum"] or "maximum" in rule and value > rule["maximum"]:
            raise ValueError(f"{name}: out of range")
