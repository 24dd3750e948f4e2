"""Temperature mixing of sources.

The token shares of the sources are raised to an exponent between 1 (as they
are) and 0 (all alike) and normalised. The exponent is bisected: it is the
largest at which the weights reach a target entropy, or, where that would
repeat a source more often than allowed, the smallest that keeps the limit.
Each source then gets its weight of the token budget, which is realised by
epochs of block permutations: documents are dealt to blocks by a keyed hash,
each epoch orders the blocks anew and the documents within them, and documents
are taken in that order while they fit the source's budget. Of each source
only the block at the end of its budget is taken in part.

Blocks bound every window, however large a source is: a source's order needs
one row per block, a block's order the rows of that block.

Defined cases: a null text counts as empty; a document without tokens is taken
with its block. Null sources are a source. Repeated rows are separate
documents that are taken or left together. Empty tables give empty results. Extra columns are kept by :func:`mix_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WORD, col, saved

#: Target entropy as a share of the greatest possible, log of the number of sources.
ENTROPY = 0.98
#: Times that a source may be repeated at most.
REPEAT = 4.0
#: Budget as a multiple of the tokens there are.
BUDGET = 1.0
#: Tokens of a block, about.
BLOCK = 2_000_000
SEED = "mix"
#: Halvings per pass over the sources, and passes.
HALVINGS, PASSES = 6, 8


def words(text: str) -> Column:
    """Tokens of a text column: words between white space."""
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def _searched(sources: DataFrame, measure, low_if) -> float:
    """The edge between exponents where ``low_if`` holds (below) and where not, by halving [0, 1].

    One pass measures all points that ``HALVINGS`` halvings can reach.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << HALVINGS
        points = [low + (high - low) * i / n for i in range(n + 1)]
        got = sources.agg(*[measure(a).alias(f"m{i}") for i, a in enumerate(points)]).first()
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if low_if(got[f"m{middle}"]) else (a, middle)
        low, high = points[a], points[b]
    return low


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, repeat: float = REPEAT) -> float:
    """The exponent for (source, tokens, share) rows; see the module."""
    k = sources.filter("tokens > 0").count()
    if k < 2:
        return 1.0
    some = sources.filter("tokens > 0")

    def spread(a: float) -> Column:
        powers = F.pow("share", F.lit(a))
        total = F.sum(powers)
        return F.log(total) - F.sum(powers * F.log(powers)) / total

    def most(a: float) -> Column:
        powers = F.pow("share", F.lit(a))
        return F.max(powers / F.col("tokens")) / F.sum(powers)

    target = entropy * math.log(k)
    at_one = some.agg(spread(1.0).alias("e"), most(1.0).alias("r"), most(0.0).alias("r0")).first()
    a = 1.0 if at_one["e"] >= target else _searched(some, spread, lambda e: e >= target)
    over = some.agg(most(a).alias("r")).first()["r"] * budget > repeat
    if over and at_one["r"] * budget <= repeat:
        # Repetition falls as the exponent rises: the first point that keeps the limit.
        a = _searched(some, most, lambda r: r * budget > repeat) + 2.0 ** -(HALVINGS * PASSES)
    elif over:
        a = 1.0
    return a


def weights(sizes: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, repeat: float = REPEAT) -> DataFrame:
    """Per source: tokens, share, weight and budget in tokens, from rows (source, tokens)."""
    sums = saved(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = exponent(shares, budget * total, entropy, repeat)
    power = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    norm = shares.agg(F.sum(power).alias("s")).first()["s"] or 1.0
    weight = power / F.lit(float(norm))
    return shares.select("source", "tokens", "share", weight.alias("weight"), F.floor(weight * F.lit(budget * total) + 1e-6).cast("bigint").alias("budget"), F.lit(a).alias("exponent"))


def _digest(*parts) -> Column:
    """A keyed order: md5 of the parts."""
    return F.md5(F.concat_ws("/", *parts).cast("binary"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """``row`` (all columns), ``source`` and ``key``, the document's digest."""
    body = F.md5(F.coalesce(col(text), F.lit("")).cast("binary"))
    key = _digest(F.lit(seed), F.coalesce(col(doc_id).cast("string"), F.lit("")), body)
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(source).alias("source"), key.alias("key"), words(text).alias("tokens"))


def _in_block(keyed: DataFrame, named: DataFrame) -> DataFrame:
    """Adds ``block``. The sources' table is joined by the planner's own choice of method."""
    blocks = named.select(F.col("source").alias("s"), "blocks")
    number = F.conv(F.substring("key", 1, 15), 16, 10).cast("bigint")
    return keyed.join(blocks, keyed["source"].eqNullSafe(blocks["s"])).withColumn("block", F.pmod(number, F.col("blocks"))).drop("s", "blocks")


def _turn(epoch: Column, key: Column, seed: str) -> Column:
    return _digest(F.lit(seed), epoch.cast("string"), key.cast("string"))


def block_plan(sizes: DataFrame, named: DataFrame, seed: str) -> DataFrame:
    """Per (source, block): epochs that take it whole, and the epoch and last turn of a part taken."""
    dealt = saved(_in_block(sizes, named), "dealt")
    per_block = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    given = named.select(F.col("source").alias("s"), F.col("tokens").alias("all"), "budget")
    each = per_block.join(given, per_block["source"].eqNullSafe(given["s"])).drop("s")
    epochs = F.when(F.col("all") > 0, F.greatest(F.lit(1), F.ceil(F.col("budget") / F.col("all")))).otherwise(1).cast("int")
    each = each.withColumn("epoch", F.explode(F.sequence(F.lit(1), epochs)))
    each = each.withColumn("turn", _digest(F.lit(seed), F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("epoch").cast("string"), F.col("block").cast("string")))
    before = "(epoch - 1) * all - t + sum(t) over (partition by source, epoch order by turn, block rows unbounded preceding)"
    placed = saved(each.withColumn("start", F.expr(before)).filter("start < budget or t = 0").drop("turn"), "placed")
    whole = placed.filter("start + t <= budget").groupBy("source", "block").agg(F.sort_array(F.collect_list("epoch")).alias("epochs"))
    part = placed.filter("start + t > budget").select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "start", "budget")
    inside = dealt.join(part, dealt["source"].eqNullSafe(part["s"]) & (dealt["block"] == part["b"])).withColumn("turn", _turn(F.col("epoch"), F.col("key"), seed))
    inside = inside.withColumn("end", F.expr("start + sum(tokens) over (partition by source, block, epoch order by turn)"))
    cuts = inside.filter("end <= budget").groupBy("source", "block").agg(F.max("epoch").alias("part_epoch"), F.max("turn").alias("part_turn"))
    both = whole.select("source", "block", "epochs", F.lit(None).cast("int").alias("part_epoch"), F.lit(None).cast("string").alias("part_turn")).unionByName(
        cuts.select("source", "block", F.lit(None).cast("array<int>").alias("epochs"), "part_epoch", "part_turn")
    )
    return both.groupBy("source", "block").agg(F.max("epochs").alias("epochs"), F.max("part_epoch").alias("part_epoch"), F.max("part_turn").alias("part_turn"))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, budget: float, entropy: float, repeat: float, block: int, seed: str) -> DataFrame:
    """``row``, ``source``, ``tokens`` and ``epoch`` of every copy taken. Texts are read twice and shuffled only if the blocks' table is too large to broadcast."""
    keyed = _keyed(docs, doc_id, text, source, seed)
    sizes = saved(keyed.select("source", "key", "tokens"), "sizes")
    named = weights(sizes, budget, entropy, repeat)
    named = saved(named.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block)).cast("bigint")), "weights")
    taken = saved(block_plan(sizes, named, seed).withColumnRenamed("source", "s").withColumnRenamed("block", "b"), "taken")
    placed = _in_block(keyed, named)
    got = placed.join(taken, placed["source"].eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    last = F.when(_turn(F.col("part_epoch"), F.col("key"), seed) <= F.col("part_turn"), F.array("part_epoch"))
    none = F.array().cast("array<int>")
    return got.select("row", "source", "tokens", F.explode(F.concat(F.coalesce("epochs", none), F.coalesce(last, none))).alias("epoch"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, entropy: float = ENTROPY, repeat: float = REPEAT, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """doc_id, source, n_tokens and epoch (from 1) of every copy of a document in the mix."""
    slim = docs.select(*[col(c) for c in dict.fromkeys([doc_id, text, source])])
    got = _mixed(slim, doc_id, text, source, budget, entropy, repeat, block, seed)
    return got.select(col(doc_id, "row").alias("doc_id"), "source", F.col("tokens").alias("n_tokens"), "epoch")


def mix_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, entropy: float = ENTROPY, repeat: float = REPEAT, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    return _mixed(docs, doc_id, text, source, budget, entropy, repeat, block, seed).select("row.*")


def realised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", budget: float = BUDGET, entropy: float = ENTROPY, repeat: float = REPEAT, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """Per source: tokens, weight and budget as targets, the tokens :func:`mix` takes, their share of all taken, and the shortfall in tokens."""
    slim = docs.select(*[col(c) for c in dict.fromkeys([doc_id, text, source])])
    sizes = slim.select(col(source).alias("source"), words(text).alias("tokens"))
    target = saved(weights(sizes, budget, entropy, repeat), "targets")
    got = mix(slim, doc_id, text, source, budget, entropy, repeat, block, seed).groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("n"))
    got = saved(got, "realised")
    total = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    taken = F.coalesce("n", F.lit(0))
    joined = target.join(got, target["source"].eqNullSafe(got["s"]), "left")
    return joined.select("source", "tokens", "weight", "budget", taken.alias("taken"), (taken / F.lit(float(max(total, 1)))).alias("realised"), (F.col("budget") - taken).alias("shortfall"))
