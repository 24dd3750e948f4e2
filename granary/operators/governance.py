"""Rules over recommendations, schemas, models, signals and golden sets: every reason that blocks is reported, not only the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.config import Pending, Ratified, read

# Types a reader may widen, and stage moves that are allowed.
WIDER = {"int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"], "string": ["bytes"], "bytes": ["string"]}
MOVES = {"none": ["staging", "archived"], "staging": ["production", "archived", "none"], "production": ["archived", "staging"], "archived": ["staging"]}
SHADOW_DAYS = 28


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; an unknown rule counts as holding, so that it blocks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))


def suitability(recommended: DataFrame, applicants: DataFrame, key: str = "borrower") -> DataFrame:
    """One row per finding: offers to drought-flagged borrowers, and debt service that stressed cash flow does not carry.

    Recommended: borrower, stage, emi. Applicants: borrower, segment,
    stressed_cash_flow. A borrower who is no applicant fails the run: an audit
    must not report clean on a population it did not review.
    """
    r = recommended.join(applicants.withColumn("known", F.lit(True)), key, "left")
    r = r.filter(F.when(F.col("known"), True).otherwise(F.raise_error(F.concat(F.lit("recommended but no applicant: "), F.col(key).cast("string")))))
    tested = F.col("segment") != "retail"
    found = {
        "drought_marketing": F.coalesce(F.col("stage") == "drought_flagged", F.lit(False)),
        "no_stressed_cash_flow": F.coalesce(tested, F.lit(True)) & F.col("stressed_cash_flow").isNull(),
        "stressed_affordability": F.coalesce(tested & (F.col("emi") * 12 > F.col("stressed_cash_flow")), F.lit(False)),
    }
    return r.select(*recommended.columns, F.explode(reasons(found)).alias("check"))


def readable(old: Column, new: Column) -> Column:
    """Whether a reader that expects one of the types ``new`` reads every type of ``old``."""
    wider = F.create_map(*[x for k, v in WIDER.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.forall(old, lambda o: F.array_contains(new, o) | F.coalesce(F.arrays_overlap(F.element_at(wider, o), new), F.lit(False)))


def compatibility(old: DataFrame, new: DataFrame, by: str = "record") -> DataFrame:
    """(record, field, severity, issue) of each change that a reader on the new schema meets in old data.

    Both: record, field, types array<string>, has_default. Only additions
    without default, types that do not widen and lost defaults break.
    """
    o = old.select(by, "field", F.col("types").alias("old_types"), F.col("has_default").alias("old_default"))
    n = new.select(by, "field", F.col("types").alias("new_types"), F.col("has_default").alias("new_default"))
    was, now = F.col("old_types").isNotNull(), F.col("new_types").isNotNull()
    issues = {
        "added_without_default": ~was & ~F.coalesce("new_default", F.lit(False)),
        "removed": ~now,
        "type_changed": was & now & ~F.coalesce(readable(F.col("old_types"), F.col("new_types")), F.lit(False)),
        "default_removed": was & now & F.coalesce("old_default", F.lit(False)) & ~F.coalesce("new_default", F.lit(False)),
    }
    x = o.join(n, [by, "field"], "full_outer").select(by, "field", F.explode(reasons(issues)).alias("issue"))
    return x.withColumn("severity", F.when(F.col("issue") == "removed", "warning").otherwise("breaking"))


def promotion_blocks(current: Column, target: Column, via_ci: Column, card: Column, report: Column, shadow_started: Column, warm: Column, trained_on: Column, definitions: Column, today: Column) -> Column:
    """What stops a model's move to a stage; evidence is asked for only on the way to production."""
    legal = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    to_production = target == "production"
    rules = {
        "illegal_transition": ~F.coalesce(F.array_contains(F.element_at(legal, current), target), F.lit(False)),
        "not_by_pipeline": ~F.coalesce(via_ci, F.lit(False)),
        "no_model_card": to_production & (F.coalesce(card, F.lit("")) == ""),
        "no_validation_report": to_production & (F.coalesce(report, F.lit("")) == ""),
        "no_shadow": to_production & shadow_started.isNull(),
        "short_shadow": to_production & F.coalesce(F.datediff(today, shadow_started) < SHADOW_DAYS, F.lit(False)),
        "fallback_cold": to_production & ~F.coalesce(warm, F.lit(False)),
        "other_definitions": to_production & ~trained_on.eqNullSafe(definitions),
    }
    return reasons(rules)


def challenges(champions: DataFrame, challengers: DataFrame, key: str = "model") -> DataFrame:
    """Lift of each challenger over the champion of its model, and what blocks it.

    Both: model, population, eval_start, eval_end, threshold, value; challengers
    also train_end and explained. Entries that differ in population, window or
    threshold are not compared: their lift is null and the mismatch is named.
    """
    same = ("population", "eval_start", "eval_end", "threshold")
    x = challengers.join(champions.select(key, *[F.col(c).alias(f"champion_{c}") for c in (*same, "value")]), key)
    unlike = {f"other_{c}": ~F.col(c).eqNullSafe(F.col(f"champion_{c}")) for c in same}
    comparable = ~(unlike["other_population"] | unlike["other_eval_start"] | unlike["other_eval_end"] | unlike["other_threshold"])
    lift = F.when(comparable, F.col("value") - F.col("champion_value"))
    rules = unlike | {"overlaps_training": F.col("eval_start") <= F.col("train_end"), "no_lift": comparable & F.coalesce(lift <= 0, F.lit(True)), "not_explained": ~F.coalesce("explained", F.lit(False))}
    return x.select(*challengers.columns, lift.alias("lift"), reasons(rules).alias("blocking"))


def retirement(precision: Column, floor: float | Pending | Ratified) -> Column:
    """Whether a signal goes: its rolling precision is below the floor; a quiet signal stays. The floor must have been set."""
    return F.coalesce(precision < read(floor), F.lit(False))


def admission(items: DataFrame, minima: dict[str, int], total: int) -> DataFrame:
    """Items of a golden set in all and by each of the columns named in ``minima``, in one pass of grouping sets, and whether each count suffices."""
    names = list(minima)
    g = items.select(*names).groupingSets([[n] for n in names] + [[]], *names).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("gid"))
    every = 2 ** len(names) - 1
    dims = [(n, every - 2 ** (len(names) - 1 - i)) for i, n in enumerate(names)]
    dim, level, least = F.lit("all"), F.lit(None).cast("string"), F.lit(total)
    for n, gid in dims:
        here = F.col("gid") == gid
        dim, level, least = F.when(here, n).otherwise(dim), F.when(here, F.col(n).cast("string")).otherwise(level), F.when(here, minima[n]).otherwise(least)
    return g.select(dim.alias("dimension"), level.alias("level"), "n", (F.col("n") >= least).alias("enough"))


def audit_size(sessions: Column, rate: float = 0.02) -> Column:
    """Sessions to audit: the rate, rounded up, at least one if there are any."""
    return F.when(sessions > 0, F.greatest(F.ceil(sessions * rate), F.lit(1))).otherwise(0)


def containment(sessions: Column, handed_off: Column) -> Column:
    return (sessions - handed_off) / F.when(sessions > 0, sessions)


def decided(rules: dict[str, tuple[Column, str]], score: Column, approve: float, decline: float) -> Column:
    """struct(outcome, decided_by, fired): the first rule that fires decides; without a score a person does; else the bands.

    ``rules`` maps a name to its condition and outcome, in order; all that fire
    are reported. The score stays beside a fired rule as evidence.
    """
    hit = {n: F.coalesce(c, F.lit(False)) for n, (c, _) in rules.items()}
    fired = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in hit.items()]))
    first = F.coalesce(*[F.when(hit[n], F.lit(o)) for n, (_, o) in rules.items()])
    usable = score.isNotNull() & ~F.isnan(score)
    by_score = F.when(score <= approve, "APPROVE").when(score >= decline, "DECLINE").otherwise("REFER")
    outcome = F.coalesce(first, F.when(usable, by_score), F.lit("REFER"))
    by = F.when(F.size(fired) > 0, "policy_rule").when(usable, "model").otherwise("fallback")
    return F.struct(outcome.alias("outcome"), by.alias("decided_by"), fired.alias("fired"))
