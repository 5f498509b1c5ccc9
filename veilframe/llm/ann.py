"""Approximate nearest neighbours by additive quantisation (Babenko and Lempitsky 2014).

A vector is coded as the sum of one word from each of several codebooks of full
dimension. Codebooks are trained on a bounded sample by k-means on residuals,
then refitted by least squares to the sample's beam-search codes. Encoding keeps
the best few partial sums from codebook to codebook. Search adds up table
look-ups of query times codeword and the stored norm of the coded vector; the
best of each block of candidates are reranked by their exact distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, partitions

#: Vectors that codebooks are trained on at most; all vectors are coded.
SAMPLE = 8192
BOOKS, WORDS, BEAM = 32, 32, 4
#: Vectors in a block, queries in a block, candidates reranked in each block of vectors.
BLOCK, QUERIES, RERANK = 4096, 512, 256


class Quantizer:
    def __init__(self, books: np.ndarray):
        self.books = books  # number, words, dimension

    @classmethod
    def train(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 5) -> Quantizer:
        rng = np.random.default_rng(seed)
        rest = x.astype(np.float64).copy()
        found = np.zeros((books, words, x.shape[1]))
        for m in range(books):
            c = rest[rng.choice(len(rest), words, replace=len(rest) < words)]
            for _ in range(8):
                near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
                count = np.bincount(near, minlength=words)
                total = np.zeros_like(c)
                np.add.at(total, near, rest)
                c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
            found[m] = c
            rest -= c[near]
        self = cls(found)
        for _ in range(2):  # refit all codewords to the beam's codes
            codes = self.encode(x)
            design = np.zeros((len(x), books * words), np.float32)
            np.put_along_axis(design, codes + np.arange(books) * words, 1.0, 1)
            gram = (design.T @ design).astype(np.float64) + 0.1 * np.eye(books * words)
            self.books = np.linalg.solve(gram, design.T.astype(np.float64) @ x + 0.1 * self.books.reshape(books * words, -1)).reshape(self.books.shape)
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (n, books) by beam search over the partial sums."""
        n, d = x.shape
        rest = x.astype(np.float64)[:, None, :]
        codes = np.zeros((n, 1, 0), np.int64)
        for c in self.books:
            width = rest.shape[1]
            cost = ((rest * rest).sum(2))[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
            parent, word = best // len(c), best % len(c)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[word] if width > 1 else np.repeat(rest, keep, 1) - c[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1) if codes.shape[2] else codes.repeat(keep, 1), word[:, :, None]], 2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(c[codes[:, m]] for m, c in enumerate(self.books))


def valid(vectors: DataFrame) -> DataFrame:
    """id, v (array of doubles) of the vectors that take part.

    Left out: null ids, null or zero vectors, those with null or non-finite
    components, and those of another dimension than most have (of equally
    frequent dimensions, the smallest stands).
    """
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col("id").cast("long").alias("id"), v.cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else -1))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _coded(shared):
    def run(batches):
        q = None
        for b in batches:
            if not b.num_rows:
                continue
            q = q or shared.value
            ids, x = b.column("id").to_numpy(), _matrix(b.column("v"))
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            codes = q.encode(x)
            norms = (q.decode(codes) ** 2).sum(1)
            block = [[ids[i : i + BLOCK].tobytes(), x[i : i + BLOCK].tobytes(), codes[i : i + BLOCK].astype(np.uint8 if WORDS <= 256 else np.uint16).tobytes(), norms[i : i + BLOCK].tobytes()] for i in range(0, len(ids), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) + i for i in range(len(block))], pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*block, strict=True))], names=["block", "ids", "vectors", "codes", "norms"])

    return run


def _query_blocks(batches):
    for b in batches:
        ids, x = b.column("id").to_numpy(), _matrix(b.column("v")) if b.num_rows else None
        for i in range(0, len(ids), QUERIES):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i : i + QUERIES].tobytes()], pa.binary()), pa.array([x[i : i + QUERIES].tobytes()], pa.binary())], names=["q_ids", "q_vectors"])


def _scan(shared, k: int, rerank: int):
    def run(batches):
        q = None
        for b in batches:
            out = []
            for q_ids, q_vectors, ids, vectors, codes, norms in zip(*(b.column(c).to_pylist() for c in ("q_ids", "q_vectors", "ids", "vectors", "codes", "norms")), strict=True):
                q = q or shared.value
                q_ids, ids, norms = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(norms)
                x, y = np.frombuffer(q_vectors).reshape(len(q_ids), -1), np.frombuffer(vectors).reshape(len(ids), -1)
                codes = np.frombuffer(codes, np.uint8 if WORDS <= 256 else np.uint16).reshape(len(ids), -1)
                tables = np.einsum("mwd,qd->qmw", q.books, x)
                for i, own in enumerate(q_ids):
                    near = norms.copy()
                    for m in range(codes.shape[1]):
                        near -= 2 * tables[i, m][codes[:, m]]
                    near[ids == own] = np.inf
                    if len(ids) > rerank:
                        edge = np.partition(near, rerank - 1)[rerank - 1]
                        at = np.flatnonzero(near < edge)
                        # of candidates with one code the smaller ids come first
                        at = np.append(at, np.flatnonzero(near == edge)[: rerank - len(at)])
                    else:
                        at = np.arange(len(ids))
                    at = at[ids[at] != own]
                    exact = np.sqrt(((y[at] - x[i]) ** 2).sum(1))
                    best = np.lexsort((ids[at], exact))[:k]
                    out.append((np.full(len(best), own), ids[at][best], exact[best]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors (id, v) for each of queries (id, v).

    score is the Euclidean distance in doubles; ties go to the smaller id. A
    vector with the query's own id is no candidate. Of query rows that repeat an
    id one is used; repeated vectors are candidates each. See valid() for what
    takes no part. Fewer than k rows if there are fewer candidates.
    """
    spark = vectors.sparkSession
    base, asked = valid(vectors), valid(queries).dropDuplicates(["id"])
    n = base.count()
    drawn = base if n <= sample else base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    x = np.array([r["v"] for r in drawn.select("v").orderBy(F.xxhash64("v")).limit(sample + sample // 4).collect()], np.float64)
    schema = "query_id long, vec_id long, score double"
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = Shared(spark, Quantizer.train(x))
    many = partitions(spark)
    blocks = base.mapInArrow(_coded(shared), "block long, ids binary, vectors binary, codes binary, norms binary")
    blocks = blocks.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(many)).cast("int"))
    # each block of queries goes once to each slot of vector blocks
    spread = asked.mapInArrow(_query_blocks, "q_ids binary, q_vectors binary").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    near = blocks.join(spread.hint("shuffle_hash"), "slot").select("q_ids", "q_vectors", "ids", "vectors", "codes", "norms").mapInArrow(_scan(shared, k, rerank), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def brute_force(rows, query_ids, k: int = 10):
    """The same by all distances, for tests: list of (query_id, rank, vec_id, score)."""
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    out = []
    for i, x in ok:
        if i in query_ids:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), j) for j, y in ok if j != i)[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(near)]
    return out
