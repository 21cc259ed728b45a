"""Search: nearest vectors, weighted terms, and the cutting of texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe.session import cut, small

QUERY_BLOCK = 20_000  # query vectors compared at once, which bounds what a task is given


def nearest(queries: DataFrame, rows: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """(query_id, row_id, cosine): the k rows nearest to each query, itself left out (ties: the lesser id).

    Queries are sent to the tasks in blocks of QUERY_BLOCK; each task keeps the k best of a slice of
    its rows for each query, so the shuffle carries k rows for a query and slice. Null or zero vectors are near to nothing.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[row_id]
    schema = f"query_id {kind}, `{row_id}` {kind}, cosine double"
    have = queries.where(F.col(vector).isNotNull()).select(row_id, vector)
    parts = []
    blocks = max(1, -(-have.count() // QUERY_BLOCK))
    numbered = have.withColumn("_b", F.pmod(F.xxhash64(row_id), F.lit(blocks)))  # about QUERY_BLOCK in each
    for b in sorted(r[0] for r in numbered.select("_b").distinct().collect()):
        block = numbered.where(F.col("_b") == b).select(row_id, vector).toPandas()
        q = np.stack([np.asarray(v, np.float64) for v in block[vector]])
        shared = spark.sparkContext.broadcast((block[row_id].to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def compare(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            ids, unit = shared.value
            for f in (b.iloc[a : a + 500] for b in frames for a in range(0, len(b), 500)):
                f = f[f["v"].notna()]
                if not len(f):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in f["v"]])
                norm = np.linalg.norm(x, axis=1)
                own = f["i"].to_numpy()
                sim = unit @ (x / np.maximum(norm, 1e-300)[:, None]).T
                sim[:, norm == 0] = -2
                sim[ids[:, None] == own[None, :]] = -2
                # The k-th best of each query tells which rows can be among the best; only those are sorted, with their ties.
                if sim.shape[1] > k:
                    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
                    width = int((sim >= least[:, None]).sum(axis=1).max())
                    near = np.argsort(np.where(sim >= least[:, None], 0, 1), axis=1, kind="stable")[:, :width]
                else:
                    near = np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
                inner = np.lexsort((own[near], -np.take_along_axis(sim, near, 1)), axis=1)[:, :k]
                order = np.take_along_axis(near, inner, 1)
                at = np.repeat(np.arange(len(ids)), order.shape[1])
                out = pd.DataFrame({"query_id": ids[at], row_id: own[order.ravel()], "cosine": sim[at, order.ravel()]})
                yield out[out["cosine"] > -2]

        parts.append(rows.select(F.col(row_id).alias("i"), F.col(vector).alias("v")).mapInPandas(compare, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), row_id)
    return got.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def tfidf_scores(docs: DataFrame, row_id: str, text: str, terms: tuple[str, ...], common: float = 0.01) -> DataFrame:
    """(row_id, score) of the documents that hold a term: the sum of the terms' normalised weights, a term's weight
    being its count times ln((1 + documents) / (1 + documents with it)) + 1. A null text holds nothing.

    Only documents that hold a term are weighed. Terms in more than a share ``common`` of the documents, of which there
    can be no more than the mean number of a document's terms over the share, are sent to all tasks where their table
    is small, so that no task gets all rows of a frequent word; the others are joined by shuffle.
    """
    n = docs.count()
    words = docs.select(row_id, F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")).alias("_d"), F.split(F.lower(text), "[^a-z0-9]+").alias("_w"))
    df = words.select(F.explode("_d").alias("term")).where(F.length("term") > 1).groupBy("term").agg(F.count("*").alias("d"))
    df = cut(df)
    asked = words.where(F.arrays_overlap("_d", F.array(*[F.lit(t) for t in terms])))
    tf = asked.select(row_id, F.explode("_w").alias("term")).where(F.length("term") > 1).groupBy(row_id, "term").agg(F.count("*").alias("n"))
    often = small(df.where(F.col("d") > common * n).select(F.col("term").alias("_t"), F.col("d").alias("_often")))
    tf = tf.join(often, F.col("term") == F.col("_t"), "left")
    rare = df.where(F.col("d") <= common * n)
    known = tf.where("_often IS NOT NULL").select(row_id, "term", "n", F.col("_often").alias("d"))
    weighed = known.unionByName(tf.where("_often IS NULL").select(row_id, "term", "n").join(rare, "term").select(row_id, "term", "n", "d"))
    weighted = weighed.withColumn("x", F.col("n") * (F.ln((1 + F.lit(n)) / (1 + F.col("d"))) + 1))
    hit = F.when(F.col("term").isin(*terms), F.col("x"))
    g = weighted.groupBy(row_id).agg(F.sum(hit).alias("_s"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return g.where("_s IS NOT NULL").select(row_id, (F.col("_s") / F.col("_n")).alias("score"))


def expanded(terms: tuple[str, ...], synonyms: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The terms and, once each, the words their synonyms stand for."""
    return tuple(dict.fromkeys([*terms, *(s for t in terms for s in synonyms.get(t, ()))]))


def scaled(scores: DataFrame, column: str) -> Column:
    """The score between the least (0) and the greatest (1) of all; 0 where they do not differ."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    return F.lit(0.0) if low is None or high - low < 1e-10 else (F.col(column) - low) / (high - low)


def fused(by_terms: DataFrame, by_vectors: DataFrame, row_id: str, weight: float = 0.6, strong: float = 0.5) -> DataFrame:
    """(row_id, score): weight of the scaled score by terms and the rest of that by vectors, a document that one side has
    not counting 0 there; where the terms find nothing, the vectors' own score above ``strong``."""
    top = by_terms.agg(F.max("score")).first()[0]
    if top is None or top <= 0.01:
        return by_vectors.where(F.col("score") > strong).select(row_id, "score")
    a = by_terms.select(row_id, scaled(by_terms, "score").alias("_a"))
    b = by_vectors.select(row_id, scaled(by_vectors, "score").alias("_b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, row_id, "full_outer").select(row_id, (weight * zero("_a") + (1 - weight) * zero("_b")).alias("score"))


def top(scores: DataFrame, row_id: str, k: int = 10) -> DataFrame:
    """The k best above 0 (ties: the lesser id): a top-k report."""
    return scores.where("score > 0").orderBy(F.desc("score"), row_id).limit(k)


def cut_text(text: str, most: int) -> list[tuple[int, str]]:
    """(start, chunk): at most ``most`` characters each, cut behind a paragraph, else a sentence, else a line, else a
    blank in the chunk's second half, else at its end. The chunks together are the text."""
    out, at = [], 0
    while len(text) - at > most:
        half, end = at + most // 2, at + most
        for mark in ("\n\n", "\f", ". ", "\n", " "):
            p = text.rfind(mark, half, end)
            if p >= 0:
                end = min(p + len(mark), end)
                break
        out.append((at, text[at:end]))
        at = end
    if at < len(text):
        out.append((at, text[at:]))
    return out


def chunks(docs: DataFrame, row_id: str, text: str, most: int) -> DataFrame:
    """(row_id, chunk_no, start, chunk) of whole texts; null and empty texts have none."""
    if most < 2:
        raise ValueError("a chunk must hold two characters at least")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a, c) for i, t in zip(f["i"], f["t"]) if t for k, (a, c) in enumerate(cut_text(t, most))]
            yield pd.DataFrame(rows, columns=[row_id, "chunk_no", "start", "chunk"])

    return docs.select(F.col(row_id).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"`{row_id}` {dict(docs.dtypes)[row_id]}, chunk_no bigint, start bigint, chunk string")
