"""Column expressions for credit outcomes, staging, pricing and loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DPD = 90
INDETERMINATE_DPD = 30
#: The ordered delinquency buckets.
BUCKETS = ["current", "1-30", "31-60", "61-89", "npa", "closed", "unknown"]


def true(c: Column) -> Column:
    """Null is not true."""
    return F.coalesce(c, F.lit(False))


def is_default(max_dpd: Column, *flags: Column) -> Column:
    out = true(max_dpd >= DEFAULT_DPD)
    for f in flags:
        out = out | true(f)
    return out


def is_indeterminate(max_dpd: Column, *flags: Column) -> Column:
    return ~is_default(max_dpd, *flags) & true(max_dpd.between(INDETERMINATE_DPD, DEFAULT_DPD - 1))


def label(max_dpd: Column, *flags: Column) -> Column:
    """BAD, INDETERMINATE or GOOD."""
    return F.when(is_default(max_dpd, *flags), "BAD").when(is_indeterminate(max_dpd, *flags), "INDETERMINATE").otherwise("GOOD")


def bucket_of(dpd: Column, closed: Column | None = None) -> Column:
    """Bucket of days past due; closed first, null unknown, negative an error."""
    ladder = F.when(true(closed), "closed") if closed is not None else F
    return (
        ladder.when(dpd.isNull(), "unknown")
        .when(dpd < 0, F.raise_error(F.lit("days past due cannot be negative")))
        .when(dpd == 0, "current")
        .when(dpd <= 30, "1-30")
        .when(dpd <= 60, "31-60")
        .when(dpd < DEFAULT_DPD, "61-89")
        .otherwise("npa")
    )


def minor_units(amount: Column) -> Column:
    """Amount in hundredths, half to even; null counts as 0."""
    return F.coalesce(F.bround(amount.cast("double") * 100).cast("bigint"), F.lit(0))


def expected_loss(pd: Column, lgd: Column, ead: Column) -> Column:
    """Rounded half to even; null if any part is."""
    return F.bround(pd * lgd * ead, 0).cast("bigint")


def emi(principal: Column, annual_rate: Column, months: Column) -> Column:
    """Level instalment; without interest principal over months."""
    i = annual_rate / 12
    growth = F.pow(1 + i, months)
    return F.when(annual_rate == 0, principal / months).otherwise(principal * i * growth / (growth - 1))


def total_interest(principal: Column, annual_rate: Column, months: Column) -> Column:
    return emi(principal, annual_rate, months) * months - principal


def scheduled_balance(principal: Column, annual_rate: Column, term: Column, elapsed: Column) -> Column:
    """Balance of an annuity after ``elapsed`` months, in whole units."""
    i = annual_rate / 12
    whole, gone = F.pow(1 + i, term), F.pow(1 + i, elapsed)
    left = F.when(annual_rate == 0, principal * (1 - elapsed / term)).otherwise(principal * (whole - gone) / (whole - 1))
    return F.when(elapsed >= term, F.lit(0)).otherwise(F.bround(left).cast("bigint"))


def clipped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which greatest and least alone would not do."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def realised_ccf(ead: Column, balance: Column, limit: Column) -> Column:
    """Share of the headroom drawn at default; undefined without headroom of one unit."""
    room = limit - balance
    return clipped((ead - balance) / F.when(room >= 1, room))


def realised_lgd(ead: Column, costs: Column, proceeds: Column) -> Column:
    return clipped((ead + costs - proceeds) / F.when(ead > 0, ead))


def downturn_lgd(lgd: Column, add_on: float) -> Column:
    return F.when(lgd.isNotNull(), F.least(F.lit(1.0), lgd + add_on))


def stage(dpd: Column, written_off: Column, red_flag: Column, lifetime: Column, at_origination: Column, sicr: float, backstop: int = 30) -> Column:
    """struct(stage, triggers): 3 if impaired; 2 with any trigger; 1 if the probability ratio can be judged; else null."""
    ratio = lifetime / F.when(at_origination > 0, at_origination)
    impaired = is_default(F.coalesce(dpd, F.lit(0)), written_off)
    triggers = F.array_compact(F.array(F.when(true(dpd >= backstop), F.lit("dpd_backstop")), F.when(true(red_flag), F.lit("ews_red_flag")), F.when(true(ratio > sicr), F.lit("sicr_pd_ratio"))))
    number = F.when(impaired, 3).when(F.size(triggers) > 0, 2).when(ratio.isNotNull(), 1)
    return F.struct(number.alias("stage"), F.when(impaired, F.array(F.lit("credit_impaired"))).otherwise(triggers).alias("triggers"))


def months_between(start: Column, end: Column) -> Column:
    """Calendar months, whatever the day."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share; (0, 1) without trials."""
    n = F.when(total > 0, total)
    p = successes / n
    d = 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce(F.greatest(F.lit(0.0), (centre - half) / d), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), (centre + half) / d), F.lit(1.0))


def logit(p: Column, floor: float = 1e-6) -> Column:
    c = clipped(p, floor, 1 - floor)
    return F.log(c / (1 - c))


def expit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def canary(key: Column, percent: float) -> Column:
    """Whether a key is in the canary share: the first 8 hexadecimal digits of its SHA-256, modulo 10,000."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint") % 10000 < percent * 100


def band_outcome(pd: Column, approve: float, decline: float) -> Column:
    return F.when(pd <= approve, "APPROVE").when(pd >= decline, "DECLINE").otherwise("REFER")


def affordability(annuity: Column, income: Column) -> Column:
    r = annuity / F.when(income > 0, income)
    return F.when(r.isNull(), "unknown").when(r < 0.15, "comfortable").when(r < 0.30, "moderate").otherwise("stretched")


def age_band(days_birth: Column) -> Column:
    """Decade of age from days before today; outside 18 to 100 null."""
    age = F.floor(-days_birth / 365.25)
    low = (F.floor(age / 10) * 10).cast("int")
    return F.when(age.between(18, 100), F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))
