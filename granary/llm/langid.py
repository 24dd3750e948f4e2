"""Language identification by prediction by partial matching over bytes.

For each language a context tree of variable order is counted on labelled
texts. With its statistics frozen, a byte's probability in a context is its
share there; a byte not seen in it costs the escape (distinct bytes against
all) times its probability in the next shorter context, down to a uniform
choice. The exact code length of every byte of a text under every language is
summed, and the shortest wins.

The trees are compiled into hash tables before scoring: one row of code lengths
(a number a language) for each context and byte that any language has seen,
and one of escapes for each context. So a byte of a text costs one lookup, and
one more for each shorter context that it must go back to.

Learning is bounded: about ``SAMPLE`` documents of a language and ``TOTAL`` in
all, chosen by the crc32 of their ids, are sent to the driver. The tables hold
what these documents hold, ``CELLS`` numbers an order at most: beyond that the
rarest grams of the order are left to the shorter contexts. Scoring covers
every byte of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Without anything to learn from, every text is ``und``. Documents with a null
language are scored, not learned from. Ties go to the language that sorts
first. Repeated rows are scored row by row; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.common import col, crc_fold, saved, small_batches

ORDER = 3
#: Documents of a language to learn from, about, and of all languages.
SAMPLE, TOTAL = 400, 20_000
#: Code lengths that the table of an order holds at most: 4 bytes each.
CELLS = 1 << 24
UNKNOWN = "und"
#: Bytes scored at once.
CHUNK = 1 << 18
#: Symbols: 0 stands before a text, bytes are above it.
SYMBOLS = 257


class Table:
    """Open addressing from codes (distinct, not negative) to their places."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(4, int(4 * len(codes) + 1).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(codes), dtype=np.int32), self._hash(codes)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            put = self.slots[at] == left
            left, at = left[~put], (at[~put] + 1) & self.mask

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those that are not in the table."""
        out = np.full(len(codes), -1, np.int32)
        if not len(self.codes):
            return out
        at = self._hash(codes)
        got = self.slots[at]
        hit = (got >= 0) & (self.codes[got] == codes)
        out[hit] = got[hit]
        left = np.flatnonzero((got >= 0) & ~hit)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.slots[at]
            hit = (got >= 0) & (self.codes[got] == codes[left])
            out[left[hit]] = got[hit]
            go = (got >= 0) & ~hit
            left, at = left[go], at[go]
        return out


class Model:
    """Compiled trees: ``languages``, and per order the grams with their ``cost`` and the contexts with their ``escape`` in bits, a column per language."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, cells: int = CELLS):
        self.order = order
        self.languages = sorted(texts)
        n = len(self.languages)
        self.grams: list[Table] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[Table] = []
        self.escape: list[np.ndarray] = []
        for k in range(order + 1):
            counted = [self._counts(texts[x], k) for x in self.languages]
            grams, total = np.unique(np.concatenate([c for c, _ in counted] or [np.zeros(0, np.int64)]), return_inverse=True)
            often = np.bincount(total, np.concatenate([c for _, c in counted]), len(grams)) if n else np.zeros(0)
            if k and len(grams) * n > cells:
                # The count at which what is more frequent fits.
                least = np.partition(often, len(grams) - cells // n)[len(grams) - cells // n]
                grams = grams[often > least]
            contexts = np.unique(grams // SYMBOLS)
            escape = np.zeros((len(contexts), n))
            seen = []
            for i, (codes, counts) in enumerate(counted):
                kept = np.isin(codes, grams)
                codes, counts = codes[kept], counts[kept]
                at = np.searchsorted(contexts, codes // SYMBOLS)
                sums, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))
                some = kinds > 0
                escape[some, i] = np.log2((sums[some] + kinds[some]) / kinds[some])
                seen.append((np.searchsorted(grams, codes), np.log2((sums[at] + kinds[at]) / counts)))
            # What a language has not seen costs its escape and the shorter context.
            cost = escape[np.searchsorted(contexts, grams // SYMBOLS)] + self._from(grams, k - 1)
            for i, (rows, bits) in enumerate(seen):
                cost[rows, i] = bits
            self.grams.append(Table(grams))
            self.contexts.append(Table(contexts))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))

    def _from(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Bits of grams (codes of any order above ``k``) by their contexts of order ``k``."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.arange(len(codes))
        for j in range(k, -1, -1):
            now = codes[left] % SYMBOLS ** (j + 1)
            at = self.grams[j].find(now)
            hit = at >= 0
            out[left[hit]] += self.cost[j][at[hit]]
            left, now = left[~hit], now[~hit]
            if not len(left):
                return out
            at = self.contexts[j].find(now // SYMBOLS)
            known = at >= 0
            out[left[known]] += self.escape[j][at[known]]
        out[left] += np.float32(8.0)
        return out

    def _counts(self, texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (context of ``k`` symbols, symbol) and their counts."""
        codes = [self._codes(np.concatenate([np.zeros(k, np.int64), np.frombuffer(t, np.uint8).astype(np.int64) + 1]), k) for t in texts if t]
        return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def _codes(symbols: np.ndarray, k: int) -> np.ndarray:
        n = len(symbols) - k
        code = symbols[:n].copy()
        for j in range(1, k + 1):
            code *= SYMBOLS
            code += symbols[j : n + j]
        return code

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text (rows) under each language (columns)."""
        total = np.zeros((len(texts), len(self.languages)))
        k = self.order
        lead = np.zeros(k, np.int64)
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def add() -> None:
            nonlocal size
            bits = self._from(np.concatenate(held), k)
            starts = np.append(0, np.cumsum([len(h) for h in held])[:-1])
            np.add.at(total, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            tail = lead
            for s in range(0, len(text), CHUNK):
                symbols = np.concatenate([tail, np.frombuffer(text[s : s + CHUNK], np.uint8).astype(np.int64) + 1])
                tail = symbols[-k:] if k else lead
                held.append(self._codes(symbols, k))
                owner.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    add()
        if held:
            add()
        return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if not text.isascii() else any(map(str.isalpha, set(text)))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        known = [bool(model.languages) and t is not None and has_letter(t) for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, k in enumerate(known) if k]
        if rows:
            bits = model.lengths([texts[i].encode() for i in rows])
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits[np.arange(len(rows)), best][:, None], 1000.0)
            sure = 1 / np.exp2(-gap).sum(axis=1)
            for i, b, p in zip(rows, best, sure, strict=True):
                names[i], scores[i] = model.languages[b], float(p)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> Model:
    """A model of all languages among the learning folds, from a bounded sample."""
    given = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).alias("lang"))
    known = given.filter("text is not null and lang is not null").filter(crc_fold("doc_id") != 0)
    counts = saved(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    quota = min(sample, TOTAL / max(1, counts.count()))
    draw = F.pmod(F.crc32(F.concat(F.lit("learn/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), F.lit(1 << 20))
    some = known.join(counts, "lang").filter(draw < F.least(F.lit(1.0), F.lit(quota) / F.col("n")) * (1 << 20))
    rows = some.select("lang", F.encode("text", "UTF-8").alias("t")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append(bytes(r["t"]))
    return Model(texts, order)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = learn(docs, doc_id, text, lang, order, sample)
    sent = spark.sparkContext.broadcast(model)
    given = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    given = given.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "text")
    schema = StructType([given.schema["doc_id"]]).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(batches, sent.value)

    return given.mapInArrow(kernel, schema)
