"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.storage import dropped, saved, shared_dir

__all__ = ["dropped", "saved", "shared_dir"]

#: What separates words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch sent to Python; long texts make the default of 10,000 too large.
ARROW_ROWS = "1000"
#: Rows of an array that one inner step of :func:`scanned` takes.
STEP = 64


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches; their bytes are bounded by Spark (64 MB unless the session says otherwise).

    The setting stays: plans are lazy and read it when they run.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > int(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def scanned(rows: str, start: str, state: str, item: str, kind: str, finish: str = "flatten(r.parts)") -> str:
    """SQL for a walk over the array ``rows`` with a running state; the array of its items, of type ``kind``.

    ``state`` and ``item`` are expressions over ``a.at``, the state before, and
    ``x``, the row; ``finish`` is one over ``r.at`` and ``r.parts``. Items are
    appended to short arrays, so the walk is linear, up to a 64th of a square.
    """
    return f"""element_at(transform(array({rows}), p -> aggregate(sequence(0, greatest(size(p) - 1, 0) div {STEP}), struct({start} as at, cast(array() as array<array<{kind}>>) as parts),
      (o, c) -> aggregate(slice(p, c * {STEP} + 1, {STEP}), struct(o.at as at, cast(array() as array<{kind}>) as found),
        (a, x) -> struct({state} as at, concat(a.found, array({item})) as found), a -> struct(a.at as at, concat(o.parts, array(a.found)) as parts)),
      r -> {finish})), 1)"""


def placed(text: str, pattern: str, hits: str, near: int) -> str:
    """SQL for the places of ``hits``, all matches of a pattern in ``text``: an array of (s, e, bs, be, v, before, after).

    ``s`` and ``e`` count code points, ``bs`` and ``be`` bytes; ``before`` and
    ``after`` are up to ``near`` code points beside the match, as far as the
    next match. Places come from the lengths of the texts between matches.
    """
    gaps = f"""element_at(transform(array(split({text}, {pattern}, -1)), g -> zip_with(zip_with(slice(g, 1, size({hits})), {hits}, (y, v) -> struct(length(y) as n, octet_length(y) as b, right(y, {near}) as before, v as v)),
      slice(g, 2, size({hits})), (y, h) -> struct(y.n as n, y.b as b, y.v as v, y.before as before, left(h, {near}) as after))), 1)"""
    item = "struct(a.at.c + x.n as s, a.at.c + x.n + length(x.v) as e, a.at.b + x.b as bs, a.at.b + x.b + octet_length(x.v) as be, x.v as v, x.before as before, x.after as after)"
    state = "struct(a.at.c + x.n + length(x.v) as c, a.at.b + x.b + octet_length(x.v) as b)"
    return scanned(gaps, "struct(0 as c, 0 as b)", state, item, PLACE)


#: Type of a place.
PLACE = "struct<s:int,e:int,bs:int,be:int,v:string,before:string,after:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str, within: str | None = None) -> "F.Column":
    """A column by its plain name, whatever characters that holds."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{within}.{quoted}" if within else quoted)


def utf8(column) -> "F.Column":
    """Text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), F.lit(b""))


def byte_lists(array: pa.Array) -> list[bytes]:
    """A binary Arrow array as Python bytes."""
    return array.to_pylist()


def crc_fold(column: str) -> "F.Column":
    """crc32 of the id as text, modulo 5; a null id counts as fold 1 (used for learning only if labelled)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5, F.lit(1))


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along axis 0) over segments that begin at ``starts``; empty segments give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.append(starts[1:], len(values))
    return total[ends] - total[starts]
