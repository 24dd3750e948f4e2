"""The computed routes as functions from a request to a plain answer; a transport is left to the caller."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granary.config import Unratified
from granary.functions import credit
from granary.operators import graph, metrics


@dataclass(frozen=True)
class Route:
    method: str
    path: str
    handler: Callable[[SparkSession, dict[str, Any]], Any]
    #: Whether the answer comes from a model that no one has bound: such a route must refuse.
    refuses: bool = False


def quote(spark: SparkSession, body: dict[str, Any]) -> dict[str, Any]:
    """Level instalment and total interest of principal, annual_rate and months."""
    p, r, n = float(body["principal"]), float(body["annual_rate"]), int(body["months"])
    if p <= 0 or r < 0 or n < 1:
        raise ValueError("principal and months must be positive, the rate not negative")
    row = spark.range(1).select(credit.emi(F.lit(p), F.lit(r), F.lit(n)).alias("instalment"), credit.total_interest(F.lit(p), F.lit(r), F.lit(n)).alias("total_interest")).first()
    return row.asDict()


def communities(spark: SparkSession, body: dict[str, Any]) -> dict[str, Any]:
    """Communities of the edges (a, b, w) and their modularity."""
    edges = spark.createDataFrame([(int(e["a"]), int(e["b"]), float(e.get("w", 1))) for e in body["edges"]], "a long, b long, w double")
    found = graph.louvain(edges)
    return {"communities": {r["node"]: r["community"] for r in found.collect()}, "modularity": graph.modularity(edges, found).first()["modularity"]}


def off_policy(spark: SparkSession, body: dict[str, Any]) -> dict[str, Any]:
    """Doubly robust value of a policy over logged decisions."""
    fields = ("taken", "target", "propensity", "reward", "q_target", "q_taken")
    log = spark.createDataFrame([tuple([str(d["taken"]), str(d["target"]), *(float(d[f]) for f in fields[2:])]) for d in body["log"]], "taken string, target string, propensity double, reward double, q_target double, q_taken double")
    return metrics.doubly_robust(log).first().asDict()


def cadence(spark: SparkSession, body: dict[str, Any]) -> dict[str, Any]:
    """Activities whose last run lies more than their days back."""
    rows = spark.createDataFrame([(a["name"], a.get("last"), int(a["every_days"])) for a in body["activities"]], "name string, last string, every_days int")
    day = F.lit(body["as_of"]).cast("date")
    late = rows.filter(F.col("last").isNull() | (F.datediff(day, F.col("last").cast("date")) > F.col("every_days")))
    return {"overdue": [r["name"] for r in late.orderBy("name").collect()]}


ROUTES = (
    Route("POST", "/v1/quotes/instalment", quote),
    Route("POST", "/v1/graph/communities", communities),
    Route("POST", "/v1/learning/offpolicy", off_policy),
    Route("POST", "/v1/learning/cadence", cadence),
    Route("POST", "/v1/assistant/answers/{session}", lambda spark, body: _refuse("generation model"), refuses=True),
)


def _refuse(name: str) -> Any:
    raise Unratified(f"no {name} is bound")


def match(method: str, path: str, routes: tuple[Route, ...] = ROUTES) -> tuple[Route | None, dict[str, str], int]:
    """(route, path parameters, status): 404 for an unknown path, 405 for a known path with another method."""
    status = 404
    for r in routes:
        m = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", r.path), path)
        if m and r.method == method:
            return r, m.groupdict(), 200
        status = 405 if m else status
    return None, {}, status


def audited(routes: tuple[Route, ...], declared: set[tuple[str, str]], refusing: set[tuple[str, str]]) -> list[str]:
    """Start-up findings: undeclared or repeated routes, and model routes that do not refuse."""
    names = [(r.method, r.path) for r in routes]
    out = [f"{m} {p}: not declared" for m, p in names if (m, p) not in declared]
    out += [f"{m} {p}: declared, not served" for m, p in sorted(declared - set(names))]
    out += [f"{m} {p}: served twice" for m, p in sorted({n for n in names if names.count(n) > 1})]
    return out + [f"{r.method} {r.path}: must refuse" for r in routes if (r.method, r.path) in refusing and not r.refuses]


def dispatch(spark: SparkSession, method: str, path: str, headers: dict[str, str], body: dict[str, Any] | None) -> tuple[int, dict[str, Any]]:
    """(status, answer). Health needs no headers; all else needs a bearer and a role, whose truth the caller's gateway checks. A refusal is an answer, with its owner."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok"}
    known = {k.lower(): v for k, v in headers.items()}
    if not known.get("authorization", "").startswith("Bearer ") or not known.get("x-role"):
        return 401, {"error": "a bearer and a role are needed"}
    route, params, status = match(method, path)
    if route is None:
        return status, {"error": "no such route" if status == 404 else "method not allowed"}
    try:
        return 200, {"result": route.handler(spark, {**(body or {}), **params})}
    except Unratified as e:
        return 200, {"refused": str(e)}
    except (KeyError, TypeError, ValueError) as e:
        return 400, {"error": str(e)}


__all__ = ["ROUTES", "Route", "audited", "cadence", "communities", "dispatch", "match", "off_policy", "quote"]
