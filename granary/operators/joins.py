"""Point-in-time, range, reconciliation and blocking joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.config import Pending, Ratified, read


def as_of(observations: DataFrame, history: DataFrame, ttl_seconds: int | None = None, bucket_seconds: int = 7 * 86400) -> DataFrame:
    """Latest value known at each distinct observation: entity, obs, value, status (found, expired, missing).

    Rows count if both clocks, of the event and of its record, are at or before
    the observation; the later record wins a tie. A value older than the time
    to live is expired, not missing.

    Nothing is joined by entity alone: both sides lie on one line of time, cut
    into buckets. The best value of a bucket is a partial aggregate, what came
    before a bucket a running maximum over an entity's buckets, and only rows
    of one entity and bucket are sorted, so an entity with a third of all rows
    is spread over its buckets. Null clocks never count.
    """
    # Known from the later of its clocks on.
    at = F.greatest("event_ts", "created_ts")
    h = history.filter("entity is not null and event_ts is not null and created_ts is not null").select("entity", at.alias("at"), F.lit(0).alias("asks"), F.struct("event_ts", "created_ts", "value").alias("w"))
    o = observations.select("entity", "obs").distinct()
    line = h.unionByName(o.select("entity", F.col("obs").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(h.schema["w"].dataType).alias("w")))
    line = line.withColumn("bucket", F.floor(F.unix_seconds("at") / bucket_seconds))
    best = line.groupBy("entity", "bucket").agg(F.max("w").alias("m"))
    earlier = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = best.select(F.col("entity").alias("e"), F.col("bucket").alias("b"), F.max("m").over(earlier).alias("carried"))
    upto = Window.partitionBy("entity", "bucket").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = line.join(before, F.col("entity").eqNullSafe(F.col("e")) & F.col("bucket").eqNullSafe(F.col("b")))
    known = placed.withColumn("w", F.greatest(F.max("w").over(upto), F.col("carried"))).filter("asks = 1").withColumnRenamed("at", "obs")
    age = F.unix_seconds("obs") - F.unix_seconds("w.event_ts")
    status = F.when(F.col("w.event_ts").isNull(), "missing")
    if ttl_seconds is not None:
        status = status.when(age > ttl_seconds, "expired")
    out = known.withColumn("status", status.otherwise("found"))
    return out.select("entity", "obs", F.when(F.col("status") == "found", F.col("w.value")).alias("value"), "status")


def online(entities: DataFrame, history: DataFrame, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    """The value that an online store would serve for each entity at ``now``: the as-of join with one observation each."""
    return as_of(entities.select("entity", now.alias("obs")), history, ttl_seconds)


def as_of_lookup(history: DataFrame, entity: object, at: Column, ttl_seconds: int | None = None) -> DataFrame:
    """One entity's value at one time, from its own rows alone."""
    own = history.filter(F.col("entity") == F.lit(entity))
    return as_of(history.sparkSession.range(1).select(F.lit(entity).cast(history.schema["entity"].dataType).alias("entity"), at.alias("obs")), own, ttl_seconds)


def coverage(joined: DataFrame) -> DataFrame:
    """Rows, missing and expired values, and the share that is not missing; null without rows."""
    n = F.count("*")
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return joined.agg(n.alias("n"), count("missing").alias("missing"), count("expired").alias("expired"), (1 - F.try_divide(count("missing"), n)).alias("coverage"))


def skew(offline: DataFrame, online: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys whose values differ between two paths; null against a value is a difference."""
    a, b = offline.select(*keys, F.col(value).alias("offline")), online.select(*keys, F.col(value).alias("online"), F.lit(True).alias("there"))
    j = a.join(b, keys, "left")
    return j.agg(F.count("*").alias("compared"), F.count(F.when(~F.col("offline").eqNullSafe(F.col("online")), 1)).alias("skewed"), F.count(F.when(F.col("there").isNull(), 1)).alias("missing_online"))


#: Keys that sources write for "unknown".
PLACEHOLDERS = ["", "0", "-", "NA", "N/A", "NULL", "NONE", "UNKNOWN", "NOT AVAILABLE", "XXX"]
KEY_LENGTH = 3


def normalised_key(raw: Column) -> Column:
    """struct(value, problem): blank, placeholder, characters, then length. The cleaned text is bound once, not repeated in each test."""

    def judged(t: Column) -> Column:
        problem = F.when(t.isNull() | (t == ""), "null_key").when(t.isin(PLACEHOLDERS), "placeholder_key").when(~t.rlike("^[A-Z0-9][A-Z0-9_-]*$"), "charset_key").when(F.length(t) < KEY_LENGTH, "too_short_key")
        return F.struct(F.when(problem.isNull(), t).alias("value"), problem.alias("problem"))

    return F.transform(F.array(F.trim(F.upper(F.regexp_replace(F.trim(raw), r"\s+", " ")))), judged)[0]


def spine(loans: DataFrame, applications: DataFrame, cases: DataFrame) -> DataFrame:
    """Every active loan with its application and cases, and a cause where there is a problem.

    loans: loan_key, customer, active. applications and cases: loan_key, customer.
    """
    active = loans.filter("active").select(normalised_key(F.col("loan_key")).alias("k"), F.col("customer"))
    a = applications.select(normalised_key(F.col("loan_key")).alias("k"), F.col("customer").alias("applicant")).filter("k.problem is null").groupBy(F.col("k.value").alias("key")).agg(F.min("applicant").alias("applicant"))
    c = cases.select(normalised_key(F.col("loan_key")).alias("k")).filter("k.problem is null").groupBy(F.col("k.value").alias("ckey")).agg(F.count("*").alias("cases"))
    j = active.join(a, F.col("k.value") == F.col("key"), "left").join(c, F.col("k.value") == F.col("ckey"), "left")
    cause = F.when(F.col("k.problem").isNotNull(), F.col("k.problem")).when(F.col("key").isNull(), "no_application").when(F.col("customer") != F.col("applicant"), "customer_differs")
    return j.select(F.col("k.value").alias("key"), "customer", "applicant", F.coalesce("cases", F.lit(0)).alias("cases"), cause.alias("cause"))


def orphans(cases: DataFrame, loans: DataFrame) -> DataFrame:
    """Cases whose key names no loan."""
    c = cases.withColumn("key", normalised_key(F.col("loan_key"))["value"])
    known = loans.select(normalised_key(F.col("loan_key"))["value"].alias("key")).filter("key is not null")
    return c.join(known, "key", "left_anti")


def reconcile(balances: DataFrame, ledger: DataFrame, mapping: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Per account of the ledger or the platform: both sums in minor units, difference and verdict. Products without an account are listed under a null one.

    balances: product, amount. ledger: account, amount. mapping: product, account.
    """
    mine = balances.join(mapping, "product", "left").groupBy("account").agg(F.sum("amount").alias("platform"))
    theirs = ledger.select(F.col("account").alias("la"), F.col("amount").alias("gl"))
    j = mine.join(theirs, F.col("account") == F.col("la"), "full").select(F.coalesce("account", "la").alias("account"), F.coalesce("platform", F.lit(0)).alias("platform"), F.coalesce("gl", F.lit(0)).alias("gl"))
    delta = F.col("platform") - F.col("gl")
    within = F.when(F.col("account").isNull(), False).when(F.col("gl") == 0, F.col("platform") == 0).otherwise(F.abs(delta) / F.abs("gl") <= tolerance)
    return j.withColumn("delta", delta).withColumn("within", within)


def candidate_pairs(records: DataFrame, keys: list[Column], id_: str = "id") -> DataFrame:
    """Unordered pairs of records that share a blocking key; null keys block nothing.

    Pairs are the contract of this operator; callers keep keys selective.
    """
    blocks = records.select(F.col(id_).alias("id"), F.explode(F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), k.cast("string")) for i, k in enumerate(keys)])))).alias("key"))
    a, b = blocks.select(F.col("id").alias("left_id"), "key"), blocks.select(F.col("id").alias("right_id"), "key")
    return a.join(b, "key").filter("left_id < right_id").select("left_id", "right_id").distinct()


def capture(alerts: DataFrame, defaults: DataFrame, lead: int | Pending | Ratified = 60) -> DataFrame:
    """Per default: captured (an alert at least ``lead`` days before), too_late or never, and the lead of the earliest alert that counts."""
    days = read(lead)
    a = alerts.select(F.col("account_id").alias("aid"), "raised")
    ahead = F.datediff("defaulted", "raised")
    j = defaults.join(a, F.col("account_id") == F.col("aid"), "left")
    per = j.groupBy("account_id", "defaulted").agg(F.max(F.when(ahead >= days, ahead)).alias("lead"), F.max(F.when(ahead >= 0, F.lit(1))).alias("any"))
    status = F.when(F.col("lead").isNotNull(), "captured").when(F.col("any") == 1, "too_late").otherwise("never")
    return per.select("account_id", "defaulted", "lead", status.alias("status"))


def hindsight(alerts: DataFrame, defaults: DataFrame) -> DataFrame:
    """Alerts raised on or after their account's default; must be empty."""
    d = defaults.select(F.col("account_id").alias("did"), "defaulted")
    return alerts.join(d, (F.col("account_id") == F.col("did")) & (F.col("raised") >= F.col("defaulted")), "left_semi")


def nearest_rank(values: Column, q: float) -> Column:
    """Nearest-rank percentile of an aggregate's values, null without any. For bounded groups; larger ones go by counts per value."""
    a = F.array_sort(F.collect_list(values))
    n = F.size(a)
    return F.when(n > 0, F.get(a, F.greatest(F.ceil(F.lit(q) * n), F.lit(1)).cast("int") - 1))


def nearest_rank_of(df: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """(q, value) by nearest rank over a whole table, from counts per distinct value."""
    every = Window.partitionBy(F.lit(0))
    g = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    g = g.withColumn("upto", F.sum("n").over(every.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(every))
    x = g.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    place = F.greatest(F.ceil(F.col("q") * F.col("all")), F.lit(1))
    return x.filter((place <= F.col("upto")) & (place > F.col("upto") - F.col("n"))).select("q", "value")


def velocity(probes: DataFrame, events: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Per probe (id, key, as_of, known_at): events of its key in [as_of - w, as_of] that had arrived by known_at.

    A range join by buckets of the widest window: each event lies in one
    bucket, each probe looks in two, and both meet by equality.
    """
    widest = max(windows.values())
    b = events.select(F.col("key").alias("k"), "event_time", "ingest_time", F.floor(F.unix_seconds("event_time") / widest).alias("bucket"))
    at = F.floor(F.unix_seconds("as_of") / widest)
    p = probes.withColumn("bucket", F.explode(F.array(at, at - 1)))
    age = F.unix_seconds("as_of") - F.unix_seconds("event_time")
    known = (F.col("event_time") <= F.col("as_of")) & (F.col("ingest_time") <= F.col("known_at"))
    j = p.join(b, (p["key"] == b["k"]) & (p["bucket"] == b["bucket"]) & known, "left")
    return j.groupBy("id", "key", "as_of", "known_at").agg(*[F.count(F.when(age <= w, 1)).alias(n) for n, w in windows.items()])
