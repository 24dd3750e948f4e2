"""The pipeline's stages against brute force over the stage before."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_small_operators import base_spans, grouped, measured, print_of


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    for k, (name, f) in enumerate(stages.items()):
        out = f(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert docs.columns == columns
        rows = docs.collect()
        now = {r["doc_id"]: r["text"] for r in rows}
        if name == "quality":
            assert set(now) == {d for d, t in before.items() if (m := measured(t or ""))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
        elif name == "simhash":
            assert set(now) == set(grouped([(d, print_of(t)) for d, t in before.items()]).values())
        elif name == "pii":
            assert set(now) == set(before) and not any(base_spans(t) for t in now.values())
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        else:
            assert set(now) <= set(before) and all(before[d] == t for d, t in now.items())
            copies = Counter(r["doc_id"] for r in rows)
            assert max(copies.values()) <= 1 + corpus_pipeline.REPEAT
        before = now
    pieces = Counter(r["doc_id"] for r in docs.filter("piece = 0").collect())
    assert pieces == copies


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names through all stages.

    The one document of source b is longer than the weight that mixing gives it.
    """
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, "en", "a", 0, "x"), (2, "", None, None, 0, "x"), (3, words + " me@x.org", "en", "a", 9, None), (3, words + " me@x.org", "en", "a", 9, None), (4, words + " me@x.org", None, "b", None, "y"), (None, words[::-1], "en", None, 5, "z"), (5, " ".join(f"t{i} {i * i}" for i in range(60_000)), "fr", "b", 7, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for name, given in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(given, schema)
        kept = []
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, "")
            out.write.parquet(f"{tmp_path}/{name}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            kept.append(sorted((r["doc_id"] or 0) for r in docs.select("doc_id").distinct().collect()))
            assert stage == "packing" or docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert kept == ([[0, 3, 4, 5], [0, 3, 5], [0, 3, 5], [0, 3], [0, 3]] if given else [[]] * 5)
