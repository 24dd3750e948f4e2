"""Removal of passages that repeat: every byte of a 100-byte string that also starts earlier.

Three steps, none of which brings all suffixes of the corpus together:

1. Each window of 100 bytes is owned by its least hashed 24-byte gram
   (leftmost among equals), so equal windows have equal owners at equal
   places. The windows of one owner form a span of at most 176 bytes. Spans
   meet by the owner's hash: a span equal to an earlier one repeats whole; an
   owner that occurs in one span only repeats nowhere.
2. Where an owner occurs in different spans, the first of each is contested.
   Their bytes meet by owner; those that can share a window (they share one of
   four 81-byte cores) form shards, whose suffix arrays are built by induced
   sorting. Suffixes in a run of common prefixes of 100 bytes or more are equal
   windows; all but the first repeat.
3. The repeated stretches of each document are united and cut out.

Owners found more than ``HOT`` times (estimated on 1 of 64 documents) are
dealt by whole windows from the start, so that a passage that a third of all
documents share does not meet in one task; repeats within a batch are settled
before any shuffle. Owners with over ``SPLIT`` different spans are known once
their spans have met: these go window by window too, so no task sorts more
than that of one owner.

Equal spans are told by two hashes of 112 bits in all (owner and content, or
two hashes of a window), not byte by byte: at 100 TB, some 3e12 spans, the
chance of a wrong equality anywhere is below 1e-8. Stretches of different
spans are compared byte by byte, by their suffixes.

Defined cases: a null text counts as empty. Ids are integers; a null id sorts
first. Repeated rows (same id and text) are one document and get the same
result; different texts under one id are ordered by a hash. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm import sais
from granary.llm.common import col, saved, small_batches, utf8

WINDOW = 100
GRAM = 24
#: Grams in a window, and so windows that one gram can own.
REACH = WINDOW - GRAM + 1
#: Grams whose places fit the low 16 bits of a value.
CHUNK = (1 << 16) - REACH
#: Spans of one owner from which its windows are dealt one by one, and the share of documents that estimates it.
HOT, ESTIMATE = 40_000, 64
#: Different spans of an owner from which their windows are dealt one by one.
SPLIT = 1024
#: Input bytes per bucket of spans, and bytes of a shard whose suffixes are sorted together.
BUCKET, SHARD = 16 << 20, 1 << 20
#: Classes of windows by the owner's place in them, and the bytes all windows of a class hold.
CLASS = 19
CORES = 4
CORE = WINDOW - CLASS
SPAN = np.dtype([("m", "<u8"), ("sh", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("s", "<i4"), ("e", "<i4"), ("x", "<i4")])


def owners(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a text: 48-bit hash of the owning gram, first and last window start, place of the gram."""
    b = np.frombuffer(text, np.uint8)
    found: list[tuple] = []
    for at in range(0, len(b) - WINDOW + 1, CHUNK):
        part = b[at : at + CHUNK + WINDOW - 1].astype(np.uint64)
        part += np.uint64(1)
        base = 0x9E3779B97F4A7C15
        h, size = part, 1
        powers = [base]
        for _ in range(4):
            powers.append(powers[-1] * powers[-1] % (1 << 64))
        for k in range(3):
            h = h[:-size] * np.uint64(powers[k]) + h[size:]
            size *= 2
        eight = h
        h = eight[:-8] * np.uint64(powers[3]) + eight[8:]
        h = h[:-8] * np.uint64(powers[3]) + eight[16:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h &= np.uint64(0xFFFFFFFFFFFF0000)
        h |= np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= REACH:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        h = np.minimum(h[: len(h) - (REACH - size)], h[REACH - size :])
        new = np.flatnonzero(h[1:] != h[:-1]) + 1
        starts, ends = np.append(0, new), np.append(new, len(h)) - 1
        value = h[starts]
        found.append((value >> np.uint64(16), starts + at, ends + at, (value & np.uint64(0xFFFF)).astype(np.int64) + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(text: bytes, doc: int, h: int, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The windows that start from ``s`` to ``e`` as spans of their own, under a hash of the window instead of the owner."""
    size = e - s + 1
    each = np.repeat(s, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros(len(each), SPAN)
    parts = [text[a : a + WINDOW] for a in each.tolist()]
    # One more bit than owners have keeps the two kinds of hash apart.
    out["m"] = np.fromiter((xxhash.xxh64_intdigest(p) >> 16 | 1 << 48 for p in parts), np.uint64, len(each))
    out["sh"] = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in parts), np.uint64, len(each))
    out["doc"], out["h"], out["s"], out["e"], out["x"] = doc, h, each, each, each
    return out


def spans(texts: list[bytes], docs: np.ndarray, hs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Spans of some documents; those of hot owners window by window, under a hash of the window instead of the owner."""
    parts = []
    for text, doc, h in zip(texts, docs.tolist(), hs.tolist(), strict=True):
        m, s, e, x = owners(text)
        if not len(m):
            continue
        heavy = np.isin(m, hot) if len(hot) else np.zeros(0, bool)
        if heavy.any():
            parts.append(windows(text, doc, h, s[heavy], e[heavy]))
            m, s, e, x = m[~heavy], s[~heavy], e[~heavy], x[~heavy]
        out = np.empty(len(m), SPAN)
        out["sh"] = np.fromiter((xxhash.xxh3_64_intdigest(text[a : b + WINDOW]) for a, b in zip(s.tolist(), e.tolist(), strict=True)), np.uint64, len(m))
        out["m"], out["doc"], out["h"], out["s"], out["e"], out["x"] = m, doc, h, s, e, x
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, SPAN)


def first_of_each(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans sorted by owner, content and place, and whether each is the first of its content. Copies of a row are dropped."""
    x = x[np.lexsort((x["s"], x["h"], x["doc"], x["sh"], x["m"]))]
    if len(x) > 1:
        again = np.ones(len(x) - 1, bool)
        for f in SPAN.names:
            again &= x[f][1:] == x[f][:-1]
        x = x[np.append(True, ~again)]
    new = np.ones(len(x), bool)
    new[1:] = (x["m"][1:] != x["m"][:-1]) | (x["sh"][1:] != x["sh"][:-1])
    return x, new


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents to blobs (bucket, settled, spans): per batch the first span of each content; the others are settled."""
    for batch in batches:
        x = spans(batch.column("utf8").to_pylist(), batch.column("doc").to_numpy(), batch.column("h").to_numpy(), hot)
        if len(x):
            yield _blobs(x, buckets)


def _blobs(x: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Spans as blobs by bucket: the first of each content, and those that repeat it, which are settled."""
    x, first = first_of_each(x)
    settled, x = x[~first], x[first]
    bucket = (x["m"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    blobs = [p.tobytes() for p in np.split(x, cuts)]
    to = bucket[np.append(0, cuts)].tolist() if len(x) else []
    flags = [False] * len(to)
    if len(settled):
        blobs.append(settled.tobytes())
        # Any bucket will do; the content of the first span would be the same one in many batches.
        to.append(xxhash.xxh3_64_intdigest(blobs[-1]) % buckets)
        flags.append(True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(flags), pa.array(blobs, pa.binary())], ["bucket", "settled", "spans"])


def _dealt_again(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents with spans of owners that have very many to blobs of single windows."""
    for batch in batches:
        parts = []
        for text, d, k, found in zip(*(batch.column(c).to_pylist() for c in ("utf8", "doc", "h", "found")), strict=True):
            some = [x for x in found if x["state"] == MANY]
            if some:
                parts.append(windows(text, d, k, np.array([x["s"] for x in some]), np.array([x["e"] for x in some])))
        if parts:
            yield _blobs(np.concatenate(parts), buckets)


#: What becomes of a span: it repeats, it is contested, or it is one of very many contested ones of its owner.
REPEATS, CONTESTED, MANY = 0, 1, 2


def _found(x: np.ndarray, state: int | np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.broadcast_to(np.asarray(state, np.int32), len(x)).copy()), pa.array(x["m"].view(np.int64)), *(pa.array(x[f]) for f in ("doc", "h")), *(pa.array(x[f].astype(np.int64)) for f in ("s", "e", "x"))]
    return pa.RecordBatch.from_arrays(columns, ["state", "m", "doc", "h", "s", "e", "x"])


FOUND = "state int, m bigint, doc bigint, h bigint, s bigint, e bigint, x bigint"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs sorted by bucket to repeated spans and contested first spans."""

    def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(blobs), SPAN)
        x = x[np.argsort(x["m"], kind="stable")]
        same = np.zeros(len(x) + 1, bool)
        same[1:-1] = x["m"][1:] == x["m"][:-1]
        x, first = first_of_each(x[same[1:] | same[:-1]])
        if not len(x):
            return
        yield _found(x[~first], REPEATS)
        x = x[first]
        _, which, counts = np.unique(x["m"], return_inverse=True, return_counts=True)
        n = counts[which]
        # A window is as small as a span gets.
        state = np.where((n > SPLIT) & (x["s"] < x["e"]), MANY, CONTESTED)
        yield _found(x[n > 1], state[n > 1])

    key, held = None, []
    for batch in batches:
        for bucket, settled, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "settled", "spans")), strict=True):
            if settled:
                yield _found(np.frombuffer(blob, SPAN), REPEATS)
                continue
            if bucket != key and held:
                yield from solve(held)
                held = []
            key = bucket
            held.append(blob)
    if held:
        yield from solve(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their contested spans to rows with the spans' bytes."""
    for batch in batches:
        m, doc, h, s, e, place, parts = [], [], [], [], [], [], []
        for text, d, k, found in zip(*(batch.column(c).to_pylist() for c in ("utf8", "doc", "h", "found")), strict=True):
            for x in found:
                if x["state"] != CONTESTED:
                    continue
                m.append(x["m"])
                doc.append(d)
                h.append(k)
                s.append(x["s"])
                e.append(x["e"])
                place.append(x["x"] - x["s"])
                parts.append(text[x["s"] : x["e"] + WINDOW])
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (m, doc, h, s, e, place)), pa.array(parts, pa.binary())], ["m", "doc", "h", "s", "e", "x", "part"])


def sharing(rows: list[tuple]) -> list[tuple]:
    """Of the spans (m, doc, h, s, e, x, part) of one owner at ``x``, the stretches (doc, h, s, e, part) that can hold a window of another span."""
    cores: dict[tuple[int, bytes], list[int]] = {}
    for i, (_, _, _, s, e, x, part) in enumerate(rows):
        for k in range(CORES):
            if max(x - CLASS * (k + 1), 0) <= min(x - CLASS * k, e - s):
                cores.setdefault((k, part[x - CLASS * k : x - CLASS * k + CORE]), []).append(i)
    alive = [[False] * CORES for _ in rows]
    for (k, _), members in cores.items():
        if len(members) > 1:
            for i in members:
                alive[i][k] = True
    out = []
    for (_, doc, h, s, e, x, part), live in zip(rows, alive, strict=True):
        ranges = [(max(x - CLASS * (k + 1), 0), min(x - CLASS * k, e - s)) for k in range(CORES - 1, -1, -1) if live[k]]
        merged: list[list[int]] = []
        for low, high in ranges:
            if low > high:
                continue
            if merged and low <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        out += [(doc, h, s + low, s + high, part[low : high + WINDOW]) for low, high in merged]
    return out


def repeats(stretches: list[tuple]) -> np.ndarray:
    """Rows (doc, h, s, e): windows s to e of a stretch that start earlier in another one."""
    order = sorted(range(len(stretches)), key=lambda i: stretches[i][:3])
    parts = [stretches[i] for i in order]
    sizes = np.array([len(p[4]) + 1 for p in parts])
    ends = np.cumsum(sizes)
    t = np.frombuffer(b"\x00".join(p[4] for p in parts) + b"\x00", np.uint8).astype(np.int64) + 1
    t = np.append(t, 0)
    sa = sais.suffix_array(t, 257)
    prefix = sais.common_prefixes(np.append(t[:-1] - 1, 0), sa, WINDOW)
    which = np.repeat(np.arange(len(parts)), sizes)
    offset = np.arange(len(which)) - np.repeat(ends - sizes, sizes)
    whole = np.append(offset + WINDOW < np.repeat(sizes, sizes), False)
    run = np.cumsum(prefix[sa] < WINDOW)
    full = whole[sa]
    at, run = sa[full], run[full]
    # Positions rise with (doc, h, start), since the stretches are sorted and do not share windows.
    rank = np.lexsort((at, run))
    at, run = at[rank], run[rank]
    again = np.zeros(len(at), bool)
    again[1:] = run[1:] == run[:-1]
    found = np.sort(at[again])
    if not len(found):
        return np.zeros((0, 4), np.int64)
    new = np.flatnonzero((np.diff(found) != 1) | (which[found[1:]] != which[found[:-1]])) + 1
    starts, stops = found[np.append(0, new)], found[np.append(new, len(found)) - 1]
    k = which[starts]
    base = np.array([p[2] for p in parts], np.int64)[k]
    ids = np.array([p[:2] for p in parts], np.int64).reshape(-1, 2)[k]
    return np.column_stack([ids, base + offset[starts], base + offset[stops]])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contested spans sorted by owner to repeated stretches, a shard of owners at a time."""
    shard: list[tuple] = []
    held, key, group = 0, None, []

    def solve() -> pa.RecordBatch:
        found = repeats(shard)
        x = np.zeros(len(found), SPAN)
        for i, f in enumerate(("doc", "h", "s", "e")):
            x[f] = found[:, i]
        return _found(x, REPEATS)

    def close() -> None:
        nonlocal held
        for y in sharing(group):
            shard.append(y)
            held += len(y[4])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("m", "doc", "h", "s", "e", "x", "part")), strict=True):
            if group and row[:4] == group[-1][:4]:
                continue  # a repeated row of the table
            if row[0] != key:
                if len(group) > 1:
                    close()
                if held >= SHARD:
                    yield solve()
                    shard, held = [], 0
                key, group = row[0], []
            group.append(row)
    if len(group) > 1:
        close()
    if shard:
        yield solve()


def united(found: list, n: int) -> list[tuple[int, int]]:
    """Maximal stretches of bytes covered by window ranges (s, e), in a text of ``n`` bytes."""
    out: list[list[int]] = []
    for s, e in sorted(found):
        e = min(e + WINDOW, n)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, digests = [], [], [], []
        for text, found in zip(batch.column("utf8").to_pylist(), batch.column("found").to_pylist(), strict=True):
            cuts = united([(x["s"], x["e"]) for x in found or ()], len(text))
            kept = hashlib.sha256()
            at = 0
            for s, e in cuts:
                kept.update(text[at:s])
                at = e
            kept.update(text[at:])
            n_bytes.append(len(text))
            n_removed.append(sum(e - s for s, e in cuts))
            n_spans.append(len(cuts))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc and h (the order of documents) and utf8."""
    given = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("t"))
    lowest = F.lit(-(1 << 63)).cast("bigint")
    return given.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("doc"), F.xxhash64("t").alias("h"), utf8(F.col("t")).alias("utf8"))


def _owner_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [owners(t)[0] for t in batch.column("utf8").to_pylist()]
        m, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(m[n > 1].view(np.int64)), pa.array(n[n > 1])], ["m", "n"])


def hot_owners(keyed: DataFrame, hot: int = HOT) -> np.ndarray:
    """Owners that about ``hot`` spans or more have, estimated on 1 of ``ESTIMATE`` documents. They decide only how spans are dealt."""
    some = keyed.filter(F.pmod(F.xxhash64("doc", "h"), F.lit(ESTIMATE)) == 0).select("utf8")
    counts = some.mapInArrow(_owner_counts, "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n"))
    rows = counts.filter(F.col("n") >= max(2, hot // ESTIMATE)).select("m").collect()
    return np.array(sorted(r["m"] for r in rows), np.int64).view(np.uint64)


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(doc, h, s, e): ranges of window starts that repeat earlier ones."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _keyed(docs, doc_id, text)
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("utf8")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    blob = "bucket bigint, settled boolean, spans binary"

    def meet(blobs: DataFrame, name: str) -> DataFrame:
        return saved(blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, FOUND), name)

    met = meet(keyed.select("doc", "h", "utf8").mapInArrow(partial(_dealt, buckets=buckets, hot=hot_owners(keyed, hot)), blob), "spans")
    asked = met.filter(F.col("state") != REPEATS).groupBy("doc", "h").agg(F.collect_list(F.struct("state", "m", "s", "e", "x")).alias("found"))
    parts = keyed.select("doc", "h", "utf8").join(asked, ["doc", "h"]).select("utf8", "doc", "h", "found")
    cut = "m bigint, doc bigint, h bigint, s bigint, e bigint, x bigint, part binary"
    solved = parts.mapInArrow(_cut, cut).repartition("m").sortWithinPartitions("m", "doc", "h", "s").mapInArrow(_sorted_shards, FOUND)
    out = met.filter(F.col("state") == REPEATS).unionByName(solved)
    many = met.filter(F.col("state") == MANY)
    if not many.isEmpty():
        wide = many.groupBy("doc", "h").agg(F.collect_list(F.struct("state", "s", "e")).alias("found"))
        dealt = keyed.select("doc", "h", "utf8").join(wide, ["doc", "h"]).select("utf8", "doc", "h", "found").mapInArrow(partial(_dealt_again, buckets=buckets), blob)
        # Windows with one 49-bit hash and another content are different, and each is the first of its content.
        out = out.unionByName(meet(dealt, "windows").filter(F.col("state") == REPEATS))
    return out.select("doc", "h", "s", "e")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    found = repeated_stretches(docs, doc_id, text, hot).groupBy("doc", "h").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    keyed = _keyed(docs, doc_id, text)
    joined = keyed.join(found, ["doc", "h"], "left").select("doc_id", "utf8", "found")
    schema = StructType([keyed.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return joined.mapInArrow(_removed, schema)
