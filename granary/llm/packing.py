"""Best-fit packing of tokenized documents into sequences of bounded length.

Hierarchical residual packing: texts are tokenized once and cut into pieces,
whose lengths are written to the shared folder. Full pieces are sequences of
their own. The others are dealt evenly to nodes, each of which packs best-fit
in order of falling length and emits its nearly full bins. The emptiest of a
node's other bins go up a tree as items: a parent merges the bins of its
children by best fit again, until one node is left. The bins that a node hands
up are at most ``CARRY``, so no node grows with the input; all others are
emitted as they are (they hold over half, so they cannot join each other).

Defined cases: a null text counts as empty and gives one piece that holds only
the end token. Repeated rows are packed once each. Ties in length go by id,
then piece. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.common import col, saved, small_batches

LENGTH = 1024
END = 2
#: Items that one node packs, about.
NODE = 20_000
#: Children of a node of the tree.
FANOUT = 16
#: Bins at most that a node hands to its parent.
CARRY = 256
#: A bin with fewer free places than this is nearly full.
SLACK = 16
#: Texts with this go through the tokenizer that knows it as a token.
SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str):
    """texts -> arrays of ids, as the tokenizers library gives them with add_special_tokens=False.

    The merges in the JSON file are ranks, which a faster byte-pair encoder
    can use; a text that spells a special token goes to the library itself, as
    does one that the faster encoder refuses: very long runs of white space.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]] or [SPECIAL]

    def encode(text: str) -> np.ndarray:
        if not any(x in text for x in special):
            try:
                return fast.encode_to_numpy(text).astype("<u4", copy=False)
            except ValueError:  # its pattern ran out of stack
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def cut(ids: np.ndarray, length: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document; of a long one only the first may be shorter."""
    n = len(ids)
    first = n % length
    edges = [0] + ([first] if first else []) + list(range(first + length, n + 1, length))
    return list(zip(edges, edges[1:], strict=False))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in batches:
        which, piece, start, size, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4", copy=False)
            for k, (s, e) in enumerate(cut(ids, length)):
                which.append(row)
                piece.append(k)
                start.append(s)
                size.append(e - s)
                crc.append(zlib.crc32(ids[s:e].tobytes()))
        columns = [batch.column(c).take(pa.array(which, pa.int64())) for c in ("doc_id", "uid")]
        columns += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: doc_id, uid (of the row), piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    given = docs.select(col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("uid"), col(text).alias("text"))
    schema = StructType([given.schema["doc_id"]]).add("uid", "long").add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return given.mapInArrow(partial(_pieces, path=path or tokenizer_path(), length=length), schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit in the order given: bin and offset of each item, and the bins' fill.

    A set of bits holds the free lengths for which there is a bin, so each
    item takes one search for the lowest bit that is high enough.
    """
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i, size in enumerate(sizes.tolist()):
        above = bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits &= ~(1 << free)
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        free -= size
        if free:
            by_free[free].append(b)
            bits |= 1 << free
    return bins, offsets, fill


def _pack(batches: Iterator[pa.RecordBatch], level: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, item, size) sorted by node, size downwards and item: (node, item, bin, offset, fill, up)."""
    held: list[pa.RecordBatch] = []

    def pack(node: int, item: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        bins, offsets, fill = best_fit(size, capacity)
        full = np.array(fill)
        order = np.argsort(full, kind="stable")[:CARRY]
        up = np.zeros(len(full), bool)
        up[order[full[order] <= capacity - SLACK]] = True
        # Unique over levels and nodes: 5 bits of level, 38 of node, 20 of bin.
        names = (level << 58) + (node << 20) + bins
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, names, offsets, full[bins], up[bins])], ["item", "bin", "offset", "fill", "up"])

    def groups(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        node, item, size = (whole.column(c).to_numpy() for c in ("node", "item", "size"))
        edges = np.flatnonzero(np.diff(node)) + 1
        for s, e in zip(np.append(0, edges), np.append(edges, len(node)), strict=True):
            yield pack(int(node[s]), item[s:e], size[s:e])

    for batch in batches:
        held.append(batch)
        node = batch.column("node")
        if batch.num_rows and node[0].as_py() != node[batch.num_rows - 1].as_py():
            whole = pa.Table.from_batches(held)
            nodes = whole.column("node").to_numpy()
            split = int(np.flatnonzero(nodes != nodes[-1])[-1]) + 1
            yield from groups(whole.slice(0, split))
            held = whole.slice(split).to_batches()
    if held and sum(b.num_rows for b in held):
        yield from groups(pa.Table.from_batches(held))


def _level(items: DataFrame, level: int, capacity: int, name: str) -> DataFrame:
    sorted_items = items.repartition("node").sortWithinPartitions("node", F.desc("size"), "item")
    return saved(sorted_items.mapInArrow(partial(_pack, level=level, capacity=capacity), "item bigint, bin bigint, offset bigint, fill bigint, up boolean"), name)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, node: int = NODE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut_up = saved(pieces(docs, doc_id, text, path, length), "pieces")
    # A row has one short piece at most, so its uid names it.
    short = cut_up.filter(F.col("length") < length)
    n = short.count()
    nodes = max(1, -(-n // node))
    items = short.select((F.pmod(F.xxhash64("uid"), F.lit(nodes))).cast("bigint").alias("node"), F.col("uid").alias("item"), F.col("length").alias("size"))
    first = _level(items, 1, length, "bins-1")
    level, moved, below = 1, None, first
    while nodes > 1:
        nodes, level = -(-nodes // FANOUT), level + 1
        up = below.filter("up").groupBy("bin").agg(F.max("fill").alias("size"))
        parent = F.shiftright(F.expr(f"bin & {(1 << 58) - 1}"), 20) % (1 << 38)
        items = up.select(F.floor(parent / FANOUT).cast("bigint").alias("node"), F.col("bin").alias("item"), "size")
        below = _level(items, level, length, f"bins-{level}")
        step = below.select(F.col("item").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("from").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
            joined = moved.join(later, "to", "left")
            moved = saved(joined.select("from", F.coalesce("to2", "to").alias("to"), (F.col("by") + F.coalesce("by2", F.lit(0))).alias("by")), "moved")
    placed = first.select("item", "bin", "offset")
    if moved is not None:
        placed = placed.join(moved, placed["bin"] == moved["from"], "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    mine = short.join(placed, short["uid"] == placed["item"]).select(*columns, F.col("bin").alias("sequence_id"), "offset")
    # Full pieces are numbered downwards from -1, bins upwards.
    whole = cut_up.filter(F.col("length") == length).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return mine.unionByName(whole)
