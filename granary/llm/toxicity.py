"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of what its own embedding and the mean embedding of
its character pairs contribute; words outside the vocabulary share one
embedding and are told apart by their characters. Both directions run over
windows of words; attention over the states pools a window, a linear layer
scores it. Windows of 48 words begin every 24 words and at the end, so any
passage of up to 25 words is whole in one; the strongest and
the mean window score give the document's probability by logistic regression.
The network is trained in numpy, by backpropagation through time.

Learning is bounded: ``SAMPLE`` documents of each label at most, about, drawn
by the crc32 of their ids from the folds other than 0; all windows of each may
be drawn in training. Of rows with one id one text is learned from. Scoring
covers every word of every text.

Defined cases: a null or empty text is scored as one empty window. Null labels
are not learned from; without both labels to learn from, every score is 0.
Repeated rows are scored row by row; extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.llm.common import col, crc_fold, small_batches, utf8

WINDOW, STRIDE = 48, 24
HIDDEN, DIM, ATTENTION = 8, 8, 8
PAIRS = 2048
VOCABULARY = 4096
#: Documents of a label that the network learns from, about.
SAMPLE = 1200
STEPS, BATCH, RATE, DECAY = 300, 128, 0.005, 0.003
#: Scale of the log odds that embeddings start with, and standard errors from which words tell of a label.
HINT, TELLING = 2.0, 3.0
#: Windows scored at once, and words whose inputs are remembered.
CHUNK, REMEMBER = 1024, 100_000
#: Documents in which a word must occur to have an embedding, and share kept for calibration.
LEAST, CALIBRATE = 4, 0.3

#: Letters and digits in lower case; other ASCII separates words.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(CLEAN).split()


def pair_codes(word: bytes) -> np.ndarray:
    """Hashed codes of the character pairs of a word, its ends included."""
    c = np.frombuffer(b"\x02" + word + b"\x03", np.uint8).astype(np.int64)
    return (c[:-1] * 31 + c[1:] * 7 + c[1:] * c[:-1]) % PAIRS


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows that cover ``n`` words; the last ends at the last word."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def recur(project, steps: int, n: int, mask: np.ndarray | None, weight: np.ndarray, keep: bool = False):
    """States (t, 2, n, h) of both directions. ``project(i)``: inputs (2, n, 3h) of step i; ``mask`` (t, 2, n): which steps count. ``keep``: also what backpropagation needs."""
    h = weight.shape[1]
    state = np.zeros((2, n, h), weight.dtype)
    states = np.empty((steps, 2, n, h), weight.dtype)
    trace = []
    for i in range(steps):
        a = project(i)
        u = np.matmul(state, weight)
        gates = a[:, :, : 2 * h] + u[:, :, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :, :h], gates[:, :, h:]
        new = r * u[:, :, 2 * h :]
        new += a[:, :, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= z
        after += new
        if mask is not None:
            after = np.where(mask[i][:, :, None], after, state)
        if keep:
            trace.append((state, r, z, new, u[:, :, 2 * h :]))
        states[i] = state = after
    return (states, trace) if keep else states


def added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their places among ``n``."""
    return np.stack([np.bincount(at, c, n) for c in rows.T], axis=1).astype(rows.dtype)


class Network:
    """Parameters, inference and training."""

    def __init__(self, vocabulary: dict[bytes, int], hints: np.ndarray, seed: int = 7):
        g = np.random.default_rng(seed)
        draw = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": draw(len(vocabulary) + 1, DIM, scale=0.1),
            "pair": draw(PAIRS, DIM, scale=0.1),
            "in": draw(2, DIM, 3 * HIDDEN, scale=0.3),
            "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "rec": draw(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "att": draw(2 * HIDDEN, ATTENTION, scale=0.3),
            "key": draw(ATTENTION, scale=0.3),
            "out": draw(2 * HIDDEN, scale=0.3),
            "off": np.zeros(1, np.float32),
        }
        # One coordinate of the embeddings starts at the word's shrunk log odds among the labels.
        self.p["word"][1:, 0] = hints
        self.final = np.zeros(3)
        self.known: dict[bytes, int] = {}
        self.inputs: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "inputs": None}

    def vectors(self, types: list[bytes]) -> np.ndarray:
        codes = [pair_codes(w) for w in types]
        counts = np.array([len(c) for c in codes])
        flat = self.p["pair"][np.concatenate(codes)]
        mean = np.add.reduceat(flat, np.append(0, np.cumsum(counts)[:-1]), axis=0) / counts[:, None]
        return self.p["word"][[self.vocabulary.get(w, 0) for w in types]] + mean

    def pooled(self, states: np.ndarray, mask: np.ndarray | None):
        """Attention over the states (t, n, 2h); ``mask`` (t, n)."""
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        hidden = np.tanh(both @ self.p["att"])
        e = hidden @ self.p["key"]
        if mask is not None:
            e = np.where(mask, e, -30.0)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        context = (weight[:, :, None] * both).sum(axis=0)
        return both, hidden, weight, context, context @ self.p["out"] + self.p["off"][0]

    def _project(self, types: list[bytes]) -> np.ndarray:
        return np.matmul(self.vectors(types)[None], self.p["in"]) + self.p["bias"]

    def _ids(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if self.inputs is None or len(self.known) > REMEMBER:
            self.known, self.inputs = {}, np.zeros((2, 1, 3 * HIDDEN), np.float32)
        known, first = self.known, len(self.known)
        ids = [np.fromiter((known.setdefault(w, len(known) + 1) for w in t), np.int32, len(t)) for t in texts]
        if len(known) > first:
            self.inputs = np.concatenate([self.inputs, self._project(list(known)[first:])], axis=1)
        return ids

    def windows(self, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Scores (logits) of windows of word numbers; ``mask``: which places hold a word."""
        out = []
        for s in range(0, len(ids), CHUNK):
            k = np.ascontiguousarray(ids[s : s + CHUNK].T)
            m = None if mask is None else mask[s : s + CHUNK].T
            buffer = np.empty((2, k.shape[1], 3 * HIDDEN), np.float32)

            def project(i: int, k=k, buffer=buffer) -> np.ndarray:
                np.take(self.inputs[0], k[i], axis=0, out=buffer[0], mode="clip")
                np.take(self.inputs[1], k[len(k) - 1 - i], axis=0, out=buffer[1], mode="clip")
                return buffer

            states = recur(project, len(k), k.shape[1], None if m is None else np.stack([m, m[::-1]], axis=1), self.p["rec"])
            out.append(self.pooled(states, m)[-1])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Strongest and mean window score of each text."""
        ids = self._ids([words(t) for t in texts])
        long = [i for i, k in enumerate(ids) if len(k) >= WINDOW]
        short = [i for i, k in enumerate(ids) if len(k) < WINDOW]
        out = np.zeros((len(texts), 2))
        if long:
            rows = [np.lib.stride_tricks.sliding_window_view(ids[i], WINDOW)[window_starts(len(ids[i]))] for i in long]
            scores = self.windows(np.concatenate(rows), None)
            starts = np.append(0, np.cumsum([len(r) for r in rows])[:-1])
            out[long, 0] = np.maximum.reduceat(scores, starts)
            out[long, 1] = np.add.reduceat(scores, starts) / np.array([len(r) for r in rows])
        if short:
            grid = np.zeros((len(short), WINDOW), np.int32)
            for row, i in enumerate(short):
                grid[row, : len(ids[i])] = ids[i]
            scores = self.windows(grid, grid > 0)
            out[short, 0] = out[short, 1] = scores
        return out

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        f = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(f @ self.final[:2] + self.final[2], -60, 60)))

    def gradients(self, grid: np.ndarray, marks: np.ndarray, word: np.ndarray, rows: np.ndarray, sizes: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows and its gradient, by backpropagation through time.

        ``grid`` (n, t): which of the words in use stands where, -1 for none.
        Per word: its place in the vocabulary (``word``), the codes of its pairs
        (``sizes`` of the flat ``rows``) and whether its characters take part (``use``).
        """
        n, steps = grid.shape
        kind = self.p["rec"].dtype
        mask = grid >= 0
        at = np.where(mask, grid, 0)
        firsts = np.append(0, np.cumsum(sizes)[:-1])
        x = self.p["word"][word] + use * np.add.reduceat(self.p["pair"][rows], firsts, axis=0) / sizes[:, None]
        a = np.matmul(x[None].astype(kind), self.p["in"]) + self.p["bias"]
        order = np.stack([at.T, at.T[::-1]], axis=1)
        masks = np.stack([mask.T, mask.T[::-1]], axis=1)
        states, trace = recur(lambda i: np.stack([a[0][order[i, 0]], a[1][order[i, 1]]]), steps, n, masks, self.p["rec"], keep=True)
        both, hidden, weight, context, z = self.pooled(states, mask.T)
        loss = float(np.mean(np.logaddexp(0, z) - marks * z))
        d = ((1 / (1 + np.exp(-z)) - marks) / n).astype(kind)
        grad = {"out": context.T @ d, "off": d.sum(keepdims=True)}
        dcontext = d[:, None] * self.p["out"]
        dweight = (both * dcontext).sum(axis=2)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        grad["key"] = np.einsum("tn,tna->a", de, hidden)
        dhidden = de[:, :, None] * self.p["key"] * (1 - hidden * hidden)
        grad["att"] = np.einsum("tnh,tna->ha", both, dhidden)
        dboth = weight[:, :, None] * dcontext + dhidden @ self.p["att"].T
        dstates = np.stack([dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
        da = np.zeros((steps, 2, n, 3 * HIDDEN), kind)
        grad["rec"] = np.zeros_like(self.p["rec"])
        dh = np.zeros((2, n, HIDDEN), kind)
        for i in range(steps - 1, -1, -1):
            state, r, zt, new, u = trace[i]
            dh = dh + dstates[i]
            live = masks[i][:, :, None]
            dn = np.where(live, dh * (1 - zt) * (1 - new * new), 0)
            dz = np.where(live, dh * (state - new) * zt * (1 - zt), 0)
            dr = dn * u * r * (1 - r)
            da[i] = np.concatenate([dr, dz, dn], axis=2)
            du = np.concatenate([dr, dz, dn * r], axis=2)
            grad["rec"] += np.matmul(state.transpose(0, 2, 1), du)
            dh = np.where(live, dh * zt, dh) + np.matmul(du, self.p["rec"].transpose(0, 2, 1))
        summed = np.stack([added(order[:, k].ravel(), da[:, k].reshape(-1, 3 * HIDDEN), len(word)) for k in range(2)])
        grad["bias"] = summed.sum(axis=1, keepdims=True)
        grad["in"] = np.matmul(x.T[None].astype(kind), summed)
        dx = np.einsum("kuj,kdj->ud", summed, self.p["in"])
        grad["word"] = added(word, dx, len(self.p["word"]))
        grad["pair"] = added(rows, np.repeat(use * dx / sizes[:, None], sizes, axis=0), PAIRS)
        return loss, grad

    def train(self, texts: list[list[bytes]], labels: np.ndarray, seed: int = 11) -> None:
        """Adam on windows of words: a document of a label by chance, then any of its windows; both labels weigh the same."""
        g = np.random.default_rng(seed)
        types = sorted({w for s in texts for w in s})
        number = {w: i for i, w in enumerate(types)}
        numbers = [np.array([number[w] for w in s], np.int64) for s in texts]
        starts = [window_starts(len(s)) for s in texts]
        vocab = np.array([self.vocabulary.get(w, 0) for w in types] or [0])
        codes = [pair_codes(w) for w in types] or [np.zeros(1, np.int64)]
        counts = np.array([len(c) for c in codes])
        flat, ends = np.concatenate(codes), np.append(0, np.cumsum(counts))
        positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            pick = np.concatenate([g.choice(positive, BATCH // 2), g.choice(negative, BATCH // 2)])
            grid = np.full((BATCH, WINDOW), -1, np.int64)
            for row, i in enumerate(pick):
                s = starts[i][g.integers(len(starts[i]))]
                part = numbers[i][s : s + WINDOW]
                grid[row, : len(part)] = part
            used, at = np.unique(np.where(grid < 0, 0, grid), return_inverse=True)
            grid = np.where(grid < 0, -1, at.reshape(BATCH, WINDOW))
            rows = np.concatenate([flat[ends[u] : ends[u + 1]] for u in used])
            # Dropping the characters of some words and the word of others keeps the two inputs from leaning on each other.
            word = np.where(g.random(len(used)) < 0.1, 0, vocab[used])
            use = (g.random(len(used)) >= 0.3).astype(np.float32)[:, None]
            _, grad = self.gradients(grid, labels[pick], word, rows, counts[used], use)
            for k, v in self.p.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (grad[k] - m1)
                m2 += 0.001 * (grad[k] ** 2 - m2)
                v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-6)
                if k in ("word", "pair"):
                    v *= 1 - DECAY
        self.inputs, self.known = None, {}

    def calibrate(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression of the labels on the strongest and the mean window score, by Newton's method."""
        f = np.column_stack([self.features(texts), np.ones(len(texts))])
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            hessian = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(3)
            w -= np.linalg.solve(hessian, f.T @ (weight * (p - labels)) + 1e-2 * w)
        self.final = w


def fit(texts: list[bytes], labels: np.ndarray, prior: float | None = None) -> Network | None:
    """A network for labelled texts; None unless both labels occur. ``prior``: the share of label 1 that scores should assume."""
    if len(set(labels.tolist())) < 2:
        return None
    g = np.random.default_rng(5)
    order = np.concatenate([g.permutation(np.flatnonzero(labels == y)) for y in (0, 1)])
    place = np.concatenate([np.arange((labels == y).sum()) / (labels == y).sum() for y in (0, 1)])
    part, rest = order[place >= CALIBRATE], order[place < CALIBRATE]
    split, marks = [words(texts[i]) for i in part], labels[part]
    seen = [Counter(), Counter()]
    for s, y in zip(split, marks, strict=True):
        seen[y].update(set(s))
    both = Counter({w: seen[0][w] + seen[1][w] for w in set(seen[0]) | set(seen[1])})
    chosen = sorted((w for w, c in both.items() if c >= LEAST), key=lambda w: (-both[w], w))
    size = [int((marks == y).sum()) for y in (0, 1)]
    odds = np.array([np.log((seen[1][w] + 0.5) / (size[1] + 1)) - np.log((seen[0][w] + 0.5) / (size[0] + 1)) for w in chosen])
    # Standard errors of the difference of the labels' shares if there is none; log odds of words never seen with a label have no usable error.
    pooled = np.array([both[w] / sum(size) for w in chosen])
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / size[0] + 1 / size[1]))
    gap = np.array([seen[1][w] / size[1] - seen[0][w] / size[0] for w in chosen])
    odds = np.where(np.abs(gap) >= TELLING * error, odds * np.array([both[w] / (both[w] + 5) for w in chosen]), 0)
    # Of more words than the vocabulary holds, those most telling of a label.
    keep = np.argsort(-np.abs(odds), kind="stable")[: min(VOCABULARY, int((odds != 0).sum()))]
    net = Network({chosen[i]: k + 1 for k, i in enumerate(keep)}, odds[keep].astype(np.float32) * HINT)
    net.train(split, marks)
    # The network hasn't seen these; weights restore the prior that sampling changed.
    share = labels[rest].mean()
    p = share if prior is None else prior
    net.calibrate([texts[i] for i in rest], labels[rest], np.where(labels[rest] == 1, p / share, (1 - p) / (1 - share)))
    return net


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Network | None:
    """The network for the learning folds of ``labels``, from a bounded sample of each label."""
    ids = labels.select(col(doc_id).alias("doc_id"), col(label).cast("int").alias("y"))
    ids = ids.filter("doc_id is not null and y in (0, 1)").filter(crc_fold("doc_id") != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.crc32(F.concat(F.lit("learn/"), F.col("doc_id").cast("string")).cast("binary")), F.lit(1 << 20))
    rate = F.when(F.col("y") == 1, F.lit(int(min(1.0, sample / max(1, counts.get(1, 0))) * (1 << 20)))).otherwise(F.lit(int(min(1.0, sample / max(1, counts.get(0, 0))) * (1 << 20))))
    drawn = ids.filter(draw < rate)
    texts = docs.select(col(doc_id).alias("doc_id"), utf8(col(text)).alias("t"))
    # At most about 2 * sample ids: a bounded side. Of the texts of one id the one with the least digest is learned from.
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min_by("t", F.md5("t")).alias("t")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["t"])))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([bytes(r["t"]) for r in rows], np.array([r["y"] for r in rows], np.int64), prior)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(learn(docs, labels, doc_id, text, label, sample))
    given = docs.select(col(doc_id).alias("doc_id"), utf8(col(text)).alias("utf8"))
    given = given.select("doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "utf8")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("utf8").to_pylist()
            p = np.zeros(len(texts)) if sent.value is None else sent.value.probabilities(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return given.mapInArrow(kernel, StructType([given.schema["doc_id"]]).add("held_out", "boolean").add("score", "double").add("predicted", "integer"))
