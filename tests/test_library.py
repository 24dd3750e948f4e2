"""Kernels, sources, streams and the rules that SQL counterparts cannot show."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import config, schemas
from granary.functions import credit, geometry, text
from granary.operators import graph, joins, kernels, panel, survival
from granary.sources import files
from granary.sources.tables import account_months
from granary.streaming import velocity


def test_policy_values_refuse():
    with pytest.raises(config.Unratified):
        config.read(config.Pending("lead days", "risk"))
    assert config.read(config.Ratified(60, "policy")) == 60 == config.read(60)


def test_features_do_not_see_the_future(spark, sf):
    m = account_months(spark, sf)
    cut = m.agg(F.expr("percentile_disc(0.5) within group (order by month_index)")).first()[0]
    moved = m.withColumn("dpd", F.when(F.col("month_index") > cut, 999).otherwise(F.col("dpd"))).withColumn("balance", F.when(F.col("month_index") > cut, 1).otherwise(F.col("balance")))
    a, b = (panel.trailing_features(x).filter(F.col("month_index") <= cut) for x in (m, moved))
    assert a.exceptAll(b).count() == 0


def test_checks(spark, sf):
    m = account_months(spark, sf)
    assert schemas.violations(m, schemas.ACCOUNT_MONTH_RULES).count() == 0
    assert schemas.duplicates(m, ["account_id", "snapshot"]).count() == 0


def test_known_answers():
    assert abs(kernels.jaro("MARTHA", "MARHTA") - 0.944444) < 1e-6
    assert abs(kernels.jaro_winkler("DIXON", "DICKSONX") - 0.813333) < 1e-6
    assert abs(kernels.normal_quantile(0.975) - 1.959964) < 1e-6
    assert abs(kernels.student_t_quantile(0.975, 10) - 2.228139) < 1e-6
    assert abs(kernels.gamma_cdf(2, 2, 1) - (1 - 3 * math.exp(-2))) < 1e-12
    assert kernels.isotonic(np.array([1, 3, 2, 4.0]), np.ones(4)).tolist() == [1, 2.5, 2.5, 4]
    assert kernels.tie_extended_bins(np.arange(4), np.array([5, 1, 1, 3]), 2).tolist() == [0, 1, 1, 1]


def test_change_points():
    g = np.random.default_rng(0)
    x = np.r_[g.normal(0, 1, 60), g.normal(6, 1, 60)]
    assert 60 <= int(np.argmax(kernels.change_probability(x)[5:])) + 5 <= 62
    assert kernels.adwin(x) and not kernels.adwin(g.normal(0, 1, 100))
    season = np.tile([0.0, 5, 10, 5, 0, -5, -10], 10) + g.normal(0, 0.5, 70)
    season[33] += 40
    assert 33 in kernels.seasonal_anomalies(season, 7) and kernels.seasonal_anomalies(season, 7, share=0.02) == [33]


def test_cox_recovers_the_hazard_ratio():
    g = np.random.default_rng(1)
    x = g.integers(0, 2, 400).astype(float)
    t = np.ceil(g.exponential(10 / np.exp(0.8 * x)))
    beta, _ = kernels.cox(np.zeros(400), t, np.ones(400, int), x[:, None])
    assert abs(beta[0] - 0.8) < 0.25
    rows, count = np.unique(np.column_stack([t, x]), axis=0, return_counts=True)
    again, _ = kernels.cox(np.zeros(len(rows)), rows[:, 0], np.ones(len(rows), int), rows[:, 1:], count)
    assert abs(again[0] - beta[0]) < 1e-6


def test_standardised_index_is_standard():
    g = np.random.default_rng(2)
    z = [v for v in kernels.standardised_index(g.gamma(2, 30, 600), 3) if v is not None]
    assert abs(np.mean(z)) < 0.1 and abs(np.std(z) - 1) < 0.1


def test_louvain_finds_two_cliques(spark):
    edges = [(a, b, 1.0) for s in (0, 10) for a in range(s, s + 5) for b in range(a + 1, s + 5)] + [(4, 10, 1.0)]
    rows = graph.louvain(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    assert {r["node"]: r["community"] for r in rows} == {i: 0 if i < 5 else 10 for i in [*range(5), *range(10, 15)]}


def test_reversed_risk_has_the_opposite_concordance(spark):
    s = panel.survival_subjects(account_months(spark, "/root/testdata/sf0.01"))
    c = [survival.concordance(s, k * F.floor(F.col("balance") / 1e7)).first()["c"] for k in (1, -1)]
    assert abs(sum(c) - 1) < 1e-9


def test_as_of_boundaries(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    history = spark.createDataFrame([(1, day(1), day(1), 1.0), (1, day(2), day(5), 2.0), (1, day(2), day(3), 3.0), (2, day(1), day(9), 4.0)], "entity long, event_ts timestamp, created_ts timestamp, value double")
    obs = spark.createDataFrame([(1, day(1)), (1, day(4)), (1, day(5)), (1, day(20)), (2, day(5)), (3, day(5))], "entity long, obs timestamp")
    got = {(r["entity"], r["obs"].day): (r["value"], r["status"]) for r in joins.as_of(obs, history, 3 * 86400).collect()}
    assert got == {(1, 1): (1.0, "found"), (1, 4): (3.0, "found"), (1, 5): (2.0, "found"), (1, 20): (None, "expired"), (2, 5): (None, "missing"), (3, 5): (None, "missing")}


def test_buckets_and_stages(spark):
    df = spark.createDataFrame([(None,), (0,), (30,), (31,), (60,), (89,), (90,)], "d int")
    assert [r[0] for r in df.select(credit.bucket_of(F.col("d"))).collect()] == ["unknown", "current", "1-30", "31-60", "31-60", "61-89", "npa"]
    s = df.select("d", credit.stage(F.col("d"), F.lit(False), F.lit(False), F.lit(None).cast("double"), F.lit(0.1), 2.0)["stage"].alias("s")).collect()
    assert [r["s"] for r in s] == [None, None, 2, 2, 2, 2, 3]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(credit.bucket_of(F.lit(-1))).collect()


def test_redaction_equals_python(spark, sf):
    rows = [(1, "aadhaar 1234 5678 9012 card 4111 1111 1111 1111 pan ABCDE1234F ifsc HDFC0ABC123 mail a.b@c.org call +91 9876543210 acct 123456789012345"), (2, "nothing 12"), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string")

    def plain(t):
        for kind, p in text.PERSONAL:
            t = re.sub(p, f"[REDACTED:{kind}]", t)
        return t

    got = {r["id"]: r["r"] for r in df.select("id", text.redacted(F.col("t"))["text"].alias("r")).collect()}
    assert got == {i: plain(t) if t is not None else None for i, t in rows}


def test_geohash_and_containment(spark):
    r = spark.range(1).select(geometry.geohash(F.lit(57.64911), F.lit(10.40744), 8).alias("g")).first()
    assert r["g"] == "u4pruydq"
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    got = spark.range(1).select(geometry.contains(square, F.lit(1.0), F.lit(1.0)), geometry.contains(square, F.lit(3.0), F.lit(1.0))).first()
    assert tuple(got) == (True, False)


def line(loan, period, dlq, code="", originated="012020", width=files.ARITY):
    f = [""] * width
    for k, v in {1: loan, 2: period, 11: "100.55", 13: originated, 39: dlq, 43: code}.items():
        f[k] = v
    return "|".join(f)


def test_performance_extract(spark, tmp_path):
    rows = [line("good", f"{m:02d}2020", "00") for m in range(1, 13)] + [line("bad", "022020", "03"), line("mid", "032020", "02"), line("mid", "122020", "00"), line("unknown", "042020", "XX"), line("paid", "052020", "00", "01"), line("loss", "052020", "00", "09"), line("end", "122020", "00")]
    (tmp_path / "p.txt").write_text("\n".join(rows))
    out = files.loan_outcomes(files.typed_performance(files.performance_rows(spark, str(tmp_path / "p.txt"))))
    assert {r["loan_id"]: r["label"] for r in out.collect()} == {"good": "GOOD", "bad": "BAD", "mid": "INDETERMINATE", "unknown": None, "paid": "GOOD", "loss": "BAD", "end": "GOOD"}
    (tmp_path / "q.txt").write_text(rows[0] + "\n" + line("x", "012020", "00", width=50))
    assert files.performance_rows(spark, str(tmp_path / "q.txt"), strict=False).count() == 1
    with pytest.raises(Exception, match="113 fields"):
        files.performance_rows(spark, str(tmp_path / "q.txt")).collect()


def test_decision_log(spark):
    rows = [("a", i, f"record {i}") for i in range(5)] + [("b", 0, "x")]
    log = files.chained(spark.createDataFrame(rows, "log string, seq long, body string"), "seq", "body")
    assert files.breaks(log, "seq", "body").count() == 0
    forged = log.withColumn("body", F.when((F.col("log") == "a") & (F.col("seq") == 2), "forged").otherwise(F.col("body")))
    assert [tuple(r) for r in files.breaks(forged, "seq", "body").collect()] == [("a", 2)]


def test_one_hot(spark):
    df = spark.createDataFrame([("1", "x"), ("99", " y "), ("n/a", None)], "a string, c string")
    out = files.one_hot(df, {"a": (0.0, 10.0)}, ["c"])
    assert out.columns == ["a", "a_missing", "c=x", "c=y"]
    assert [tuple(r) for r in out.collect()] == [(1.0, 0.0, 1.0, 0.0), (10.0, 0.0, 0.0, 1.0), (5.0, 1.0, 0.0, 0.0)]


def test_stream_equals_batch(spark, sf, tmp_path):
    """The stateful counter gives what the range join gives, late events included."""
    from granary.sources.tables import two_clock_events

    ev = two_clock_events(spark, sf).filter("key % 10 = 1").select(F.col("key").cast("string").alias("key"), F.date_trunc("second", "event_time").alias("event_time"), F.date_trunc("second", "ingest_time").alias("ingest_time"))
    ev = ev.dropDuplicates(["key", "event_time"])
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = velocity.counted(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["key"], r["event_time"]): (r["n_1h"], r["n_24h"], r["n_7d"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    probes = ev.select(F.monotonically_increasing_id().alias("id"), "key", F.col("event_time").alias("as_of"), F.col("ingest_time").alias("known_at"))
    batch = joins.velocity(probes, ev, {"n_1h": 3600, "n_24h": 86400, "n_7d": 604800})
    assert got == {(r["key"], r["as_of"]): (r["n_1h"], r["n_24h"], r["n_7d"]) for r in batch.collect()}
    assert velocity.freshness(ev).first()["p99"] == 7200.0
