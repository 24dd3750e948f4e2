"""Lexical, dense and fused retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import terms
from granary.storage import saved

K1, B, RRF = 1.2, 0.75, 60


def postings(chunks: DataFrame, id_: str, text: str) -> DataFrame:
    """(chunk, length, term, tf). A chunk's terms are counted where its text is read: the counts need one shuffle by chunk and term."""
    t = chunks.select(F.col(id_).alias("chunk"), terms(F.col(text)).alias("ts")).withColumn("length", F.size("ts"))
    return t.select("chunk", "length", F.explode("ts").alias("term")).groupBy("chunk", "length", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, query_id: str, query_text: str, id_: str, text: str, eligible: Column | None = None) -> DataFrame:
    """query, chunk, score and rank of the best k chunks; document frequencies are global, whatever is eligible.

    Only postings of terms that a query holds are kept before they are counted.
    """
    q = queries.select(F.col(query_id).alias("query"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    # Texts are split into terms once; lengths and postings are read back.
    p = chunks.select(F.col(id_).alias("chunk"), terms(F.col(text)).alias("ts"), (eligible if eligible is not None else F.lit(True)).alias("eligible"))
    p = saved(p.select("chunk", "eligible", F.size("ts").alias("length"), "ts"), "terms")
    sizes = p.agg(F.count("*").alias("chunks"), F.avg("length").alias("average"))
    p = p.select("chunk", "eligible", "length", F.explode("ts").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    p = p.groupBy("chunk", "eligible", "length", "term").agg(F.count("*").alias("tf"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    # One row of totals.
    w = q.join(df, "term").crossJoin(F.broadcast(sizes))
    idf = F.log((F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    j = p.filter("eligible").join(w.select("query", "term", "qf", idf.alias("idf"), "average"), "term")
    part = F.col("qf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return ranked(j.groupBy("query", "chunk").agg(F.sum(part).alias("score")).filter("score > 0"), k)


def ranked(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best k per query, ties to the smaller chunk; a query's candidates are cut in parts before they meet."""
    s = F.round("score", digits)
    w = Window.partitionBy("query", "part").orderBy(F.desc(s), "chunk")
    cut = scored.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(64))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    w = Window.partitionBy("query").orderBy(F.desc(s), "chunk")
    return cut.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "chunk", "score", "rank")


#: Vectors of a block, and queries of a block.
VECTORS, QUERIES = 4096, 1024


def _blocks(rows: DataFrame, id_: str, v: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt to blocks of about ``size``: (name, ids, vs), and their number."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.groupBy(F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias(name))
    return dealt.agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))).alias(f"{name}_rows")), n


def cosine(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact cosine top k of other ids. queries: query, v. vectors: chunk, v. Ties at ``digits`` digits go to the smaller id.

    Queries meet vectors block by block in matrix products; only the best k of
    a query in a block leave it. Vectors of no length score null and are left out.
    """
    q, _ = _blocks(queries.filter("v is not null"), "query", "v", QUERIES, "q")
    c, n = _blocks(vectors.filter("v is not null"), "chunk", "v", VECTORS, "c")
    met = q.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(c, "c")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(rows) -> tuple[np.ndarray, np.ndarray]:
            x = np.array([list(r["v"]) for r in rows], float)
            with np.errstate(invalid="ignore"):
                return np.array([r["id"] for r in rows]), x / np.sqrt((x * x).sum(axis=1))[:, None]

        for pdf in batches:
            for left, right in zip(pdf["q_rows"], pdf["c_rows"], strict=True):
                (asked, a), (ids, b) = unit(left), unit(right)
                scores = a @ b.T
                for i, row in enumerate(scores):
                    order = np.lexsort((ids, -np.floor(row * 10.0**digits + 0.5)))
                    order = order[(ids[order] != asked[i]) & np.isfinite(row[order])][:k]
                    yield pd.DataFrame({"query": np.repeat(asked[i], len(order)), "chunk": ids[order], "score": row[order]})

    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["chunk"].dataType.simpleString()
    return ranked(met.select("q_rows", "c_rows").mapInPandas(solve, f"query {kinds[0]}, chunk {kinds[1]}, score double"), k, digits)


def fused(legs: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, chunk, rank)."""
    both = legs[0].select("query", "chunk", "rank")
    for leg in legs[1:]:
        both = both.unionByName(leg.select("query", "chunk", "rank"))
    return ranked(both.groupBy("query", "chunk").agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score")), k)


def hit_rate(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of the queries of ``relevant`` (query, chunk) that have a relevant chunk among their first k."""
    hits = relevant.join(ranking.filter(F.col("rank") <= k).select("query", "chunk", F.lit(1).alias("hit")), ["query", "chunk"], "left")
    return hits.groupBy("query").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit")).agg(F.count("*").alias("queries"), F.avg("hit").alias("hit_rate"))


def effective(docs: DataFrame, day: Column) -> DataFrame:
    """Documents in force: from at or before the day, to open or at or after it."""
    return docs.filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))


def conflicts(docs: DataFrame, day: Column) -> DataFrame:
    """Pairs in force on a day of one kind and one product, neither superseding the other. docs: id, kind, product, supersedes."""
    now = effective(docs, day)
    a, b = now.alias("a"), now.alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.product") == F.col("b.product")) & (F.col("a.id") < F.col("b.id"))
    free = ~F.coalesce(F.col("a.supersedes") == F.col("b.id"), F.lit(False)) & ~F.coalesce(F.col("b.supersedes") == F.col("a.id"), F.lit(False))
    return a.join(b, same & free).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.kind").alias("kind"))


def reranked(candidates: DataFrame, queries: DataFrame, texts: DataFrame, score: Column, k: int) -> DataFrame:
    """The candidates' first k by another scorer, an expression (or a pandas UDF over a model) on ``query_text`` and ``passage``.

    Candidates: query, chunk. Queries: query, query_text. Texts: chunk, passage.
    A candidate whose text is missing scores null and goes last.
    """
    x = candidates.select("query", "chunk").join(queries.select("query", "query_text"), "query").join(texts.select("chunk", "passage"), "chunk", "left")
    return ranked(x.select("query", "chunk", F.coalesce(score, F.lit(float("-inf"))).alias("score")), k)
