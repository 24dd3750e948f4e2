"""Exact top-k inner products over norm-sorted vectors.

Vectors are read as integers floor(64 x). All are rotated by the right singular
vectors of the whole table, which gathers their weight in the first
coordinates. Candidates lie in blocks sorted by falling length. Queries are
grouped by length; each group first meets the longest blocks, which gives every
query a k-th score to beat. The blocks that a group must still meet are those
whose greatest length times the group's reaches the least of these scores; as
blocks are sorted, they are a prefix, and no other block is sent to the group.
Within a block the first rotated coordinates are added up, and candidates go
for which that sum plus the product of the remaining lengths (Cauchy-Schwarz)
stays below the query's k-th score. Scores of the rest are computed on the
integers themselves and are exact, whatever their size.

The stated queries meet the candidates in cells: one group of queries and one
stripe of blocks, both bounded in bytes; the best of each cell are merged by
query in two steps.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id. A candidate with the query's own id is its
own row. Of rows with one id the least vector counts. Vectors of different
lengths are padded with zeros. Ties go to the smaller id. Scores beyond the
range of a long count as the nearest long. A component whose 64-fold is beyond
the range of a double counts as not finite.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import col, saved

SCALE = 64
TOP = 20
#: Vectors of a group of queries and of a candidate block, of 64 components; longer ones make smaller blocks.
QUERIES, BLOCK = 4096, 2048
#: Candidate blocks of a stripe, and the blocks that set the scores to beat.
STRIPE, SEEDS = 32, 4
#: Rotated coordinates in the first partial sum.
HEAD = 16
#: Tasks that add up Gram matrices before the driver does, and stripes whose best are merged first.
ADDERS, MERGED = 32, 64
#: Range of a long; the least one stands for no score.
LOW, HIGH = -(1 << 63) + 2, (1 << 63) - 1
NONE = LOW - 1


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (array of whole doubles) of the rows that take part, one per id."""
    v = col(embedding)
    sound = v.isNotNull() & col(vec_id).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf"))), F.lit(False))
    rows = vectors.filter(sound).select(col(vec_id).cast("bigint").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    # Spark's floor returns a long; from 2**52 every double is whole.
    whole = lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)
    return rows.select("id", F.transform("v", lambda x: whole(x.cast("double") * SCALE)).alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    counts = np.diff(column.offsets.to_numpy())
    if len(counts) and (counts == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(counts), size))
    out[np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(c) for c in counts]) if len(counts) else []] = flat
    return out


def _gram(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size, size))
    for batch in batches:
        x = _matrix(batch.column("v"), size)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])


def _added(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((size, size))
    for batch in batches:
        for g in batch.column("gram").to_pylist():
            total += np.frombuffer(g).reshape(size, size)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["gram"])


def rotation(rows: DataFrame, size: int) -> np.ndarray:
    """Right singular vectors of the table (columns, largest first). Gram matrices are added by task, then by ``ADDERS`` tasks; the driver adds those."""
    parts = rows.select("v").mapInArrow(partial(_gram, size=size), "gram binary").repartition(ADDERS)
    total = np.zeros((size, size))
    for r in parts.mapInArrow(partial(_added, size=size), "gram binary").collect():
        total += np.frombuffer(r["gram"]).reshape(size, size)
    # Squares beyond the range of a double leave the coordinates as they are.
    return np.linalg.eigh(total / max(1.0, np.abs(total).max()))[1][:, ::-1].copy() if np.isfinite(total).all() else np.eye(size)


def _bytes(x: np.ndarray) -> bytes:
    """Vectors as 4-byte integers where they fit, else as doubles."""
    return (x.astype("<i4") if len(x) and np.abs(x).max() < 1 << 31 else x.astype("<f8")).tobytes()


def _vectors(blob: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(blob, "<i4" if len(blob) == 4 * n * size else "<f8").reshape(n, size).astype(np.float64)


def _packed(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows (id, v) as blocks (ids, vectors, longest) of at most ``block`` rows."""
    ids, rows, held = [], [], 0

    def emit() -> pa.RecordBatch:
        i, x = np.concatenate(ids), np.concatenate(rows)
        longest = float(np.sqrt((x**2).sum(axis=1).max()))
        return pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([_bytes(x)]), pa.array([longest])], ["ids", "vectors", "longest"])

    for batch in batches:
        i, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), size)
        at = 0
        while at < len(i):
            stop = min(len(i), at + block - held)
            ids.append(i[at:stop])
            rows.append(x[at:stop])
            held += stop - at
            at = stop
            if held == block:
                yield emit()
                ids, rows, held = [], [], 0
    if held:
        yield emit()


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles as longs: exact, those beyond the range as the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**52:
        return np.rint(a @ b.T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(c) for c in r] for r in x], object)
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)


def best(queries: np.ndarray, own: np.ndarray, blocks, turn: np.ndarray, top: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best candidates of each query among ``blocks``; -1 as id where there are fewer. ``floors``: scores that others already reach."""
    n, size = queries.shape
    head = min(HEAD, size)
    turned = queries @ turn
    lengths = np.sqrt((queries**2).sum(axis=1))
    rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
    scores = np.full((n, top), NONE)
    ids = np.full((n, top), -1, np.int64)
    least = np.full(n, NONE) if floors is None else floors
    for block_ids, vectors, longest in blocks:
        floor = np.maximum(scores[:, -1], least).astype(np.float64)
        # No score yet, or one that may stand for any lower one.
        floor[floor <= LOW] = -np.inf
        # Rounding errors are a share of the product of lengths, not of the sum.
        slack = lengths * longest * 1e-9 + 1
        live = np.flatnonzero(~(lengths * longest + slack < floor))
        if not len(live):
            continue
        spun = vectors @ turn
        tail = np.sqrt((spun[:, head:] ** 2).sum(axis=1))
        bound = turned[live, :head] @ spun[:, :head].T + rest[live][:, None] * tail[None, :] + slack[live][:, None]
        may = ~(bound < floor[live][:, None])
        may &= own[live][:, None] != block_ids[None, :]
        columns = np.flatnonzero(may.any(axis=0))
        if not len(columns):
            continue
        got = exact(queries[live], vectors[columns])
        for row, q in enumerate(live):
            c = np.flatnonzero(may[row, columns])
            if not len(c):
                continue
            s, k = np.concatenate([scores[q], got[row, c]]), np.concatenate([ids[q], block_ids[columns[c]]])
            if len(s) > 4 * top:
                enough = s >= np.partition(s, len(s) - top)[len(s) - top]
                s, k = s[enough], k[enough]
            order = np.lexsort((k, -s))[:top]
            scores[q], ids[q] = s[order], k[order]
    return scores, ids


def _grid(batches: Iterator[pa.RecordBatch], turn: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell; in a cell the group of queries first, then candidate blocks by falling length."""
    size = len(turn)
    cell: tuple | None = None
    asked: tuple | None = None
    waiting: list = []

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("q", "stripe", "kind", "ids", "vectors", "longest", "floors")), strict=True)

    def solve() -> pa.RecordBatch:
        own, vectors, floors = asked
        scores, ids = best(vectors, own, waiting, turn, top, floors)
        real = scores > NONE
        n = int(real.sum())
        columns = [np.full(n, cell[0]), np.full(n, cell[1]), np.repeat(own, top).reshape(-1, top)[real], ids[real], scores[real]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["q", "stripe", "query_id", "vec_id", "score"])

    for q, stripe, kind, ids, vectors, longest, floors in rows():
        if cell != (q, stripe):
            if asked and waiting:
                yield solve()
            cell, asked, waiting = (q, stripe), None, []
        i = np.frombuffer(ids, np.int64)
        x = _vectors(vectors, len(i), size)
        if kind == 0:
            asked = (i, x, np.frombuffer(floors, np.int64) if floors else None)
        elif asked:
            waiting.append((i, x, longest))
    if asked and waiting:
        yield solve()


GRID = "q bigint, stripe bigint, query_id bigint, vec_id bigint, score bigint"
CELL = ["q", "stripe", "kind", "ids", "vectors", "longest", "floors"]


def _solved(groups: DataFrame, blocks: DataFrame, turn: np.ndarray, top: int) -> DataFrame:
    """Best candidates of every cell: groups (q, stripe, …) and blocks (q, stripe, …) that meet."""
    both = groups.withColumn("kind", F.lit(0)).select(*CELL).unionByName(blocks.withColumn("kind", F.lit(1)).withColumn("floors", F.lit(None).cast("binary")).select(*CELL))
    cells = both.repartition("q", "stripe").sortWithinPartitions("q", "stripe", "kind", F.desc("longest"))
    return cells.mapInArrow(partial(_grid, turn=turn, top=top), GRID)


def _merged(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The best ``top`` rows by score, then id, of each key."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))))
    return found.groupBy(*keys).agg(F.slice(pairs, 1, top).alias("best"))


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups with the pairs (id, k-th score) of their queries: adds the scores in the order of the ids, and the least score to reach."""
    for batch in batches:
        out, low = [], []
        for ids, known in zip(batch.column("ids").to_pylist(), batch.column("known").to_pylist(), strict=True):
            scores = {x["query_id"]: x["floor"] for x in known or ()}
            floors = np.array([scores.get(i, NONE) for i in np.frombuffer(ids, np.int64).tolist()], np.int64)
            out.append(floors.tobytes())
            low.append(int(floors.min()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "ids", "vectors", "longest")), pa.array(out, pa.binary()), pa.array(low, pa.int64())], ["q", "ids", "vectors", "longest", "floors", "low"])


def cells(groups: DataFrame, blocks: DataFrame, stripe: int, seeds: int) -> DataFrame:
    """(q, stripe) of the cells that are left after the seeds: blocks ``b`` of a group while their longest vector can reach the group's least score."""
    lengths = blocks.filter(F.col("b") >= seeds).groupBy((F.col("b") / stripe).cast("bigint").alias("stripe")).agg(F.max("longest").alias("most"))
    reach = F.col("group_longest") * F.col("most") * (1 + 1e-9) + 1 >= F.col("low")
    # One row a stripe and one a group: the pairs that stay are the cells to be solved.
    return groups.select("q", F.col("longest").alias("group_longest"), "low").join(lengths, reach).select("q", "stripe")


def top_products(vectors: DataFrame, every: int = 20, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the best candidates of every query (ids divisible by ``every``)."""
    spark = vectors.sparkSession
    rows = saved(integers(vectors, vec_id, embedding).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), "vectors")
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()["d"]
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not size:
        return spark.createDataFrame([], schema)
    turn = rotation(rows, size)
    share = max(1, size // 64)
    blob = "ids binary, vectors binary, longest double"

    def grouped(some: DataFrame, block: int, name: str, number: str) -> DataFrame:
        """Blocks of vectors by falling length, numbered in that order."""
        ordered = some.select("id", "v", "length").repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), "id")
        packed = saved(ordered.select("id", "v").mapInArrow(partial(_packed, size=size, block=max(1, block // share)), blob).withColumn("place", F.monotonically_increasing_id()), name)
        # Places name the blocks of a task; one row a task turns them into one running number.
        tasks = [(r["task"], r["n"]) for r in packed.groupBy(F.shiftright("place", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()]
        before = np.append(0, np.cumsum([n for _, n in tasks])).tolist()
        starts = spark.createDataFrame([(t, b) for (t, _), b in zip(tasks, before, strict=False)] or [(-1, 0)], "task bigint, first bigint")
        within = F.col("place") - F.shiftleft(F.shiftright("place", 33), 33)
        return packed.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("task")).withColumn(number, F.col("first") + within).drop("place", "task", "first")

    asked = grouped(rows.filter(F.col("id") % every == 0), QUERIES, "queries", "q")
    groups = asked.count()
    if not groups:
        return spark.createDataFrame([], schema)
    blocks = grouped(rows, BLOCK, "blocks", "b")
    # Every group meets the longest blocks first.
    seed = F.lit(-1).cast("bigint").alias("stripe")
    seeds = blocks.filter(F.col("b") < SEEDS).select(F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("q"), seed, "ids", "vectors", "longest")
    first = saved(_solved(asked.select("*", seed, F.lit(None).cast("binary").alias("floors")), seeds, turn, top), "seeds")
    kth = _merged(first, ["q", "query_id"], top).filter(F.size("best") == top).select("q", "query_id", (-F.element_at("best", -1)["s"]).alias("floor"))
    known = kth.groupBy("q").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))
    floored = asked.join(known, "q", "left").select("q", "ids", "vectors", "longest", "known")
    floored = saved(floored.mapInArrow(_floors, "q bigint, ids binary, vectors binary, longest double, floors binary, low bigint"), "floors")
    met = saved(cells(floored, blocks, STRIPE, SEEDS), "cells")
    striped = blocks.filter(F.col("b") >= SEEDS).withColumn("stripe", (F.col("b") / STRIPE).cast("bigint"))
    rest = _solved(floored.join(met, "q"), striped.join(met, "stripe"), turn, top)
    parts = first.unionByName(rest).withColumn("part", (F.col("stripe") / MERGED).cast("bigint"))
    some = _merged(parts, ["query_id", "part"], top).select("query_id", F.explode("best").alias("x")).select("query_id", (-F.col("x.s")).alias("score"), F.col("x.v").alias("vec_id"))
    ranked = _merged(some, ["query_id"], top)
    return ranked.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score"))
