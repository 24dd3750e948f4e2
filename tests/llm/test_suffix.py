"""Repeated passages against a search over all windows."""

import hashlib
import random

from granary.llm import suffix


def brute(rows, window=suffix.WINDOW):
    """rows: (doc_id, text bytes) -> {doc_id: (n_bytes, n_removed, n_spans, sha256)}"""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        gone = bytearray(len(text))
        for i in range(len(text) - window + 1):
            w = text[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\x01" * window
            seen.add(w)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def planted(seed):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdeé") for _ in range(g.randint(1, 8)))
    passages = [" ".join(word() for _ in range(g.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(g.randint(0, 40))) for _ in range(3)]
        if g.random() < 0.7:
            p = g.choice(passages)
            k = g.randint(0, 30)
            parts.insert(1, p[k : len(p) - g.randint(0, 30)])
        rows.append((i * 3 % 61, " ".join(parts)))
    rows += [(100, "a" * 500), (101, "a" * 150 + "b" + "a" * 150), (102, "xyz" * 90), (103, ""), (104, "short"), (105, "q" * 100), (106, "q" * 99)]
    copy = rows[5][1]
    rows += [(200 + i, copy) for i in range(10)] + [(300 + i, copy[:200] + str(i) + copy[200:]) for i in range(10)]
    return rows


def test_planted(spark):
    for seed in (1, 2):
        rows = planted(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert result(suffix.repeated_passages(df)) == brute([(d, t.encode()) for d, t in rows])


def test_hot_owners_are_dealt_by_window(spark):
    rows = planted(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = suffix.owners(rows[5][1].encode())[0]
    old = suffix.hot_owners
    suffix.hot_owners = lambda keyed, n: hot
    try:
        got = result(suffix.repeated_passages(df))
    finally:
        suffix.hot_owners = old
    assert got == brute([(d, t.encode()) for d, t in rows])


def test_owners_with_many_spans_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT", 3)
    for seed in (4, 5):
        rows = planted(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert result(suffix.repeated_passages(df)) == brute([(d, t.encode()) for d, t in rows])


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    assert result(suffix.repeated_passages(docs)) == brute(rows)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet " * 2000
    rows = [(None, long, 1), (5, None, 2), (7, "same " * 40, 3), (7, "same " * 40, 3), (9, long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m int")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.repeated_passages(df).collect()}
    assert (9, len(long), len(long)) in got and (5, 0, 0) in got
    assert sum(1 for r in suffix.repeated_passages(df).collect() if r["doc_id"] == 7) == 2
    assert suffix.repeated_passages(df.limit(0)).count() == 0
