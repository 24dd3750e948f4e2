"""Quality rules with host verdicts.

A kernel measures every whole text. Failures of each rule are then counted by
host, each rule's failure rates are shrunk with a beta prior fitted to all
hosts by the method of moments, and a host fails all its documents where the
posterior of a rule's rate lies above ``MAX_HOST_RATE``: its mean less
``SURE`` standard deviations. The prior and that margin treat small hosts; no
host is left out for its size.

Two rules fail a document by themselves (``base_failed``): too few words and
too many repeated ones. Two more count against hosts only: many symbols, and
many repeated lines.

Defined cases: a null text counts as empty, so it has no words and fails. A
document without a host gets no host verdict. Repeated rows are judged row by
row. An empty table gives an empty result. Extra columns are kept by
:func:`keep_good` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.llm.common import col, saved, small_batches, utf8

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Symbols per hundred characters of words, and repeated lines per hundred words, that fail a document of a host.
MAX_SYMBOL_PERCENT, MAX_LINE_PERCENT = 10, 10
#: A host fails when a rule's shrunk failure rate, less this many standard deviations, exceeds the limit.
MAX_HOST_RATE, SURE = 0.5, 1.0
#: rule -> SQL condition over the measures.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars",
    "lines": f"100 * n_dup_lines > {MAX_LINE_PERCENT} * n_words",
}

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
NOT_COUNTED = SPACES + bytes(range(0x80, 0xC0))
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # Exact: pairs of codes are renumbered densely, so a window of 8 takes three doublings.
    size = 1
    while size < WINDOW:
        pairs = codes[:-size] * (int(codes.max()) + 1) + codes[size:]
        _, codes = np.unique(pairs, return_inverse=True)
        size *= 2
    often = np.bincount(codes)[codes] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, NOT_COUNTED)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x) for x in batch.column("utf8").to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *FIELDS])


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``), the five measures and ``base_failed``."""
    small_batches(docs.sparkSession)
    given = docs.select(F.struct(*[col(c) for c in keep]).alias("row"), utf8(col(text)).alias("utf8"))
    schema = StructType([given.schema["row"], *(StructField(f, LongType()) for f in FIELDS)])
    return given.mapInArrow(_kernel, schema).withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeats']}"))


def _prior(k: int, n: int, mean: float, squares: float) -> tuple[float, float]:
    """Beta prior of rates over ``k`` hosts and ``n`` documents, from their mean and the sum of f * f / n. With no more spread than chance gives, rates shrink fully to the mean."""
    spread, strength = mean * (1 - mean), 1e6
    if k > 1 and spread > 0 and n > k:
        variance = k / (k - 1) * (squares - n * mean * mean) / n
        excess = (variance - spread * k / n) / (spread * (1 - k / n))
        strength = min(1e6, max(2.0, 1 / excess - 1)) if excess > 0 else 1e6
    return max(mean, 1e-9) * strength, max(1 - mean, 1e-9) * strength


def host_verdicts(stats: DataFrame, host) -> DataFrame:
    """Per host: documents ``n``, failures ``f_rule`` and shrunk rate ``rate_rule`` of each rule, and ``host_failed``. The priors come from one pass of sums over all hosts."""
    failures = [F.sum(F.expr(rule).cast("long")).alias(f"f_{r}") for r, rule in RULES.items()]
    hosts = saved(stats.filter(host.isNotNull()).groupBy(host.alias("host")).agg(F.count("*").alias("n"), *failures), "hosts")
    sums = [x for r in RULES for x in ((F.sum(f"f_{r}") / F.sum("n")).alias(f"m_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"s_{r}"))]
    whole = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), *sums).first()
    rates, failed = [], F.lit(False)
    for r in RULES:
        a, b = _prior(whole["k"], whole["n"], whole[f"m_{r}"], whole[f"s_{r}"]) if whole["k"] else (1.0, 1.0)
        rate = (F.col(f"f_{r}") + a) / (F.col("n") + a + b)
        rates.append(rate.alias(f"rate_{r}"))
        failed = failed | (rate - SURE * F.sqrt(rate * (1 - rate) / (F.col("n") + a + b + 1)) > MAX_HOST_RATE)
    return hosts.select("*", *rates, failed.alias("host_failed"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: id, measures, ``base_failed``, ``kept``, and the host's shrunk rate of each rule."""
    stats = saved(measured(docs, [doc_id, host] if doc_id != host else [doc_id], text), "quality")
    rates = [f"rate_{r}" for r in RULES]
    verdicts = host_verdicts(stats, col(host, "row")).select("host", *rates, "host_failed")
    joined = stats.join(verdicts, col(host, "row") == F.col("host"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))
    return joined.select(col(doc_id, "row").alias("doc_id"), *FIELDS, "base_failed", kept.alias("kept"), *rates)


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with all their columns. Texts are measured once, written once and never shuffled: the few failed hosts are joined to them."""
    whole = measured(docs, docs.columns, text)
    slim = whole.select(col(host, "row").alias("host"), *FIELDS, F.when(~F.col("base_failed"), F.col("row")).alias("row"))
    stats = saved(slim, "measured")
    bad = saved(host_verdicts(stats, F.col("host")).filter("host_failed").select(F.col("host").alias("failed")), "failed-hosts")
    return stats.filter("row is not null").join(bad, F.col("host") == F.col("failed"), "left_anti").select("row.*")
