"""SimHash fingerprints and near-duplicate groups at a Hamming distance of 3.

Deletion-variant signatures: a fingerprint is cut into two segments of 32
bits. Of three differing bits one segment holds at most one, so it is indexed
under its exact value and under the 32 values with one bit deleted. Equal keys
meet in one task, which verifies whole distances and keeps a spanning forest
of each bucket, never its pairs. Only distinct fingerprints take part, so a
group of exact copies is a single row. A bucket above ``BUCKET`` members is
split by the other segment, of whose four bytes three differing bits leave one
as it is: a member goes to the four buckets of its bytes. What is still above
the limit is cut into blocks, and every pair of blocks is a bucket of its own.

Defined cases: a null text counts as empty; texts without words have
fingerprint zero and are linked like any other. Repeated rows share a group.
Rows with a null id get a fingerprint and the smallest id of their group.
Empty tables give empty results. Extra columns are kept by
:func:`keep_representatives` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.llm.common import col, saved, small_batches, utf8
from granary.operators.graph import components

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Largest bucket that is compared as it is; larger ones are split, then cut into blocks of half this size.
BUCKET = 32768
#: Shingles hashed at once, which bounds memory on very long texts.
CHUNK = 65536


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a UTF-8 text: majority bit of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
        n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    done = 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    while done < n:
        k = min(CHUNK, n - done)
        h = np.fromiter(map(digest, (next(grams) for _ in range(k))) if n > CHUNK else map(digest, grams), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += k
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column("utf8").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found)], ["row", "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``row`` (a struct of the columns ``keep``) and ``fp``, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    given = docs.select(F.struct(*[col(c) for c in keep]).alias("row"), utf8(col(text)).alias("utf8"))
    return given.mapInArrow(_fingerprints, StructType([given.schema["row"], StructField("fp", LongType())]))


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of fingerprints within the distance; (child, parent) positions.

    Each value is compared once with those not reached yet, all at a time.
    """
    left = np.arange(len(values))
    child, parent, queue = [], [], []
    while len(left) or queue:
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(values[left] ^ values[at]) <= MAX_DISTANCE
        if near.any():
            reached = left[near]
            left = left[~near]
            child.append(reached)
            parent.append(np.full(len(reached), at))
            queue.extend(reached)
    none = np.zeros(0, np.int64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to a star per component: each node and the smallest node that these edges reach."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, key, fp) sorted by slot and key to links (a, b); the links of a task are contracted to stars."""
    kept_a: list[np.ndarray] = []
    kept_b: list[np.ndarray] = []
    held = 0
    rest: list[np.ndarray] | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held
        if kept_a:
            a, b = union(np.concatenate(kept_a), np.concatenate(kept_b))
            kept_a[:], kept_b[:], held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def groups(slot: np.ndarray, key: np.ndarray, fp: np.ndarray) -> None:
        nonlocal held
        new = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, new), np.append(new, len(slot))
        some = ends - starts > 1
        two = ends - starts == 2
        i = starts[two]
        near = (np.bitwise_count(fp[i] ^ fp[i + 1]) <= MAX_DISTANCE) & (fp[i] != fp[i + 1])
        if near.any():
            kept_a.append(fp[i[near]])
            kept_b.append(fp[i[near] + 1])
            held += int(near.sum())
        for s, e in zip(starts[some & ~two], ends[some & ~two], strict=True):
            values = np.unique(fp[s:e])
            c, p = forest(values)
            if len(c):
                kept_a.append(values[c])
                kept_b.append(values[p])
                held += len(c)

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        now[2] = now[2].view(np.uint64)
        if rest is not None:
            now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            groups(*(x[:cut] for x in now))
        rest = [x[cut:] for x in now]
        if held > 500_000:
            yield from flush()
    if rest is not None and len(rest[0]):
        groups(*rest)
    yield from flush()


def _keyed(distinct: DataFrame) -> DataFrame:
    """(slot, key, fp): each of the two segments exact (slot 32 or 65) and with one bit deleted (slots 0-31 and 33-64)."""
    segment = "case half when 0 then shiftrightunsigned(fp, 32) else fp & 4294967295 end"
    halves = distinct.selectExpr("fp", "explode(array(0, 1)) as half").selectExpr("fp", "half", f"{segment} as seg")
    return halves.selectExpr("fp", "half", "seg", "explode(sequence(0, 32)) as bit").selectExpr(
        "cast(half * 33 + bit as int) as slot", "if(bit = 32, seg, seg & ~shiftleft(1L, bit)) as key", "fp"
    )


def _split(keyed: DataFrame, distinct: DataFrame) -> DataFrame:
    """Split buckets that may exceed ``BUCKET`` by the bytes of the other segment, and cut what stays large into pairs of blocks.

    A bucket with a deleted bit unites two segment values, so only segments
    with over half the limit can be part of a large one; there are few.
    """
    counts = distinct.selectExpr("stack(2, 0, shiftrightunsigned(fp, 32), 1, fp & 4294967295) as (half, seg)").groupBy("half", "seg").count()
    hot = saved(counts.filter(F.col("count") > BUCKET // 2), "hot-segments")
    if hot.isEmpty():
        return keyed
    large = hot.selectExpr("half", "seg", "explode(sequence(0, 32)) as bit").selectExpr("cast(half * 33 + bit as int) as slot", "if(bit = 32, seg, seg & ~shiftleft(1L, bit)) as key").distinct()
    marked = keyed.join(large.withColumn("hot", F.lit(True)), ["slot", "key"], "left")
    cool = marked.filter("hot is null").select("slot", "key", "fp")
    other = "if(slot < 33, fp & 4294967295, shiftrightunsigned(fp, 32))"
    bytes_ = marked.filter("hot").selectExpr("slot", "key", "fp", f"{other} as other", "explode(array(0, 8, 16, 24)) as at")
    split = saved(bytes_.selectExpr("slot", "xxhash64(key, at, shiftrightunsigned(other, at) & 255) as key", "fp"), "split-buckets")
    sizes = split.groupBy("slot", "key").count().filter(F.col("count") > BUCKET)
    blocks = sizes.select("slot", "key", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("blocks"))
    dealt = split.join(blocks, ["slot", "key"], "left").withColumn("mine", F.expr("cast(pmod(xxhash64(fp), coalesce(blocks, 1)) as int)"))
    dealt = dealt.withColumn("other", F.expr("explode(sequence(0, coalesce(blocks, 1) - 1))"))
    pair = F.expr("if(blocks is null, key, xxhash64(key, least(mine, other), greatest(mine, other)))")
    return cool.unionByName(dealt.select("slot", pair.alias("key"), "fp"))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all close pairs."""
    keyed = _split(_keyed(distinct), distinct)
    return keyed.repartition("slot", "key").sortWithinPartitions("slot", "key").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id reachable."""
    prints = saved(fingerprints(docs, [doc_id], text).select(col(doc_id, "row").alias("doc_id"), "fp"), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp")))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").selectExpr("fp", "first", "coalesce(root, fp) as root")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = saved(grouped.join(firsts, "root").select(F.col("fp").alias("of"), "component_id"), "components")
    return prints.join(named, prints["fp"] == named["of"], "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the smallest id that the group has, of its texts the one with the smallest md5.

    Ids may repeat or be null. A group of which no row has an id keeps one row.
    """
    body = F.md5(utf8(col(text)))
    slim = docs.select(col(doc_id).alias("id"), body.alias("body"), col(text).alias("text"))
    # The least (no id, id, body) of a group, so that a null id stands only where the group has no other.
    rank = F.struct(F.col("row.id").isNull().alias("none"), F.col("row.id").alias("id"), F.col("row.body").alias("body"))
    distinct = saved(fingerprints(slim, ["id", "body"]).groupBy("fp").agg(F.min(rank).alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    chosen = grouped.groupBy("root").agg(F.min("least").alias("least"))
    picked = saved(chosen.select(F.col("least.id").alias("picked_id"), F.col("least.body").alias("picked_body")), "representatives")
    mark = "_".join(["body", *docs.columns])
    rows = docs.withColumn(mark, body)
    kept = rows.join(picked, col(doc_id).eqNullSafe(picked["picked_id"]) & (col(mark) == picked["picked_body"]), "left_semi")
    return kept.dropDuplicates([doc_id, mark]).drop(mark)
