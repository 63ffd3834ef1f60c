"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of M codebooks,
found by beam search; its code and the norm of that sum are stored. For a query,
|q - x|^2 ~ |q|^2 - 2 sum_m <q, c_m> + |x'|^2 comes from a table of inner products. The
`rerank` best of the whole index, however many blocks that has, are then ranked by the
exact distance, in double precision.

Equal vectors are one entry, with the k + 1 smallest of their ids, so that copies crowd
nothing out; repeated rows are candidates each for itself. Every row is coded; only the codebooks are fitted on a bounded sample. Codes
and vectors are stored apart: scoring reads the codes alone. Queries go against all blocks
in groups of bounded size; a task passes on `rerank` candidates for each query.

Defined cases: rows without an id, and vectors that are null, empty or zero, hold null or
non-finite components, or differ in length from the most common length (of equals the
shortest), take no part; where an id that asks has several vectors, the first in order
asks; with fewer candidates than asked for all are returned; ties go to the smaller id; a
row with a query's id is never its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdom.llm.common import materialize

#: Vectors of a block, those that are ranked exactly for a query, queries scored at once, bytes of queries broadcast at once.
BLOCK, RERANK, TOGETHER, GROUP_BYTES = 4096, 800, 256, 2 << 20


class AdditiveQuantizer:
    def __init__(self, books: int = 24, words: int = 64, beam: int = 8, seed: int = 7):
        self.books, self.words, self.beam, self.seed = books, words, beam, seed

    def fit(self, x: np.ndarray, rounds: int = 2) -> AdditiveQuantizer:
        """Residual k-means, then rounds of beam-search codes and least-squares codebooks."""
        rng = np.random.default_rng(self.seed)
        k = self.words = max(1, min(self.words, len(x)))
        rest, books = x.astype(np.float64).copy(), []
        for _ in range(self.books):
            c = rest[rng.choice(len(rest), k, replace=False)].copy()
            for _ in range(8):
                near = (-2 * rest @ c.T + (c * c).sum(1)).argmin(1)
                n = np.bincount(near, minlength=k)
                sums = np.zeros_like(c)
                np.add.at(sums, near, rest)
                c[n > 0] = sums[n > 0] / n[n > 0, None]
            near = (-2 * rest @ c.T + (c * c).sum(1)).argmin(1)
            rest -= c[near]
            books.append(c)
        self.set(np.array(books))
        for _ in range(rounds):
            codes = self.encode(x)[0].astype(np.int64)
            hot = np.zeros((len(x), self.books * k))
            for m in range(self.books):
                hot[np.arange(len(x)), m * k + codes[:, m]] = 1
            solved = np.linalg.solve(hot.T @ hot + 1e-1 * np.eye(hot.shape[1]), hot.T @ x + 1e-1 * self.c.reshape(-1, x.shape[1]))
            self.set(solved.reshape(self.c.shape))
        return self

    def set(self, c: np.ndarray) -> None:
        self.c = c.astype(np.float32)
        self.norms = (self.c**2).sum(2)
        flat = self.c.reshape(-1, self.c.shape[2])
        self.cross = (flat @ flat.T).reshape(self.books, self.words, self.books, self.words)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and squared norms of what they add up to."""
        parts = [self._beam(x[i : i + 512].astype(np.float32)) for i in range(0, len(x), 512)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _beam(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(x), self.words
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for m in range(self.books):
            step = self.norms[m] - 2 * (x @ self.c[m].T)
            every = cost[:, :, None] + step[:, None, :]
            for i in range(m):
                every += 2 * self.cross[i, codes[:, :, i], m]
            flat = every.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            cost = np.take_along_axis(flat, best, 1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], 1), (best % k)[:, :, None]], 2)
        won = codes[np.arange(n), cost.argmin(1)]
        total = sum(self.c[m, won[:, m]] for m in range(self.books))
        return won.astype(np.uint8), (total * total).sum(1)

    def scores(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """|q - x|^2 without |q|^2, from the table of inner products."""
        table = np.einsum("qd,mkd->mqk", q.astype(np.float32), self.c)
        inner = table[0][:, codes[:, 0]]
        for m in range(1, self.books):
            inner += table[m][:, codes[:, m]]
        return norms - 2 * inner


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision; squares are added up one component after the other, as a plain loop does."""
    squares = (x.astype(np.float64) - q) ** 2
    return np.sqrt(np.add.accumulate(squares, 1)[:, -1])


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): every different vector, with the k + 1 smallest of its ids, each as often as it has rows (k times at most).

    Rows are counted first, which deals the copies of a vector out by their ids; the limit of
    the ranks is applied before the second exchange too, so a frequent vector sends a few
    rows a task.
    """
    once = rows.groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = once.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    listed = few.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("listed"))
    return listed.select("embedding", F.flatten(F.transform("listed", lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"))


def build(vectors: DataFrame, quantizer: AdditiveQuantizer, kind: str) -> DataFrame:
    """Blocks of entries as binaries: block, n, codes, norms, vectors, ids, each (how many ids a vector has)."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                part = b.slice(s, BLOCK)
                x = _matrix(part.column(0), np.dtype(kind))
                codes, norms = sent.value.encode(x)
                ids = part.column(1)
                each = pc.list_value_length(ids).to_numpy().astype(np.int32)
                held = (("codes", codes), ("norms", norms.astype(np.float32)), ("vectors", x), ("ids", ids.flatten().to_numpy()), ("each", each))
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "n": pa.array([len(x)], pa.int32()), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in held}})
                number += 1

    return vectors.select("embedding", "ids").mapInArrow(run, "block long, n int, codes binary, norms binary, vectors binary, ids binary, each binary")


def _candidates(index: DataFrame, quantizer: AdditiveQuantizer, q: np.ndarray, rerank: int) -> DataFrame:
    """query (a row of q), and the scores, blocks and rows of each task's `rerank` best for it, as binaries: a row for each task and query."""
    sent = index.sparkSession.sparkContext.broadcast((quantizer, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aq, q = sent.value
        near = np.full((len(q), 0), 0, np.float32)
        blocks, rows = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int32)
        for b in batches:
            for block, n, codes, norms in zip(*b.columns, strict=True):
                n = n.as_py()
                codes, norms = np.frombuffer(codes.as_py(), np.uint8).reshape(n, -1), np.frombuffer(norms.as_py(), np.float32)
                parts = [aq.scores(q[s : s + TOGETHER], codes, norms) for s in range(0, len(q), TOGETHER)]
                best = [np.argpartition(p, rerank - 1, 1)[:, :rerank] if rerank < n else np.tile(np.arange(n), (len(p), 1)) for p in parts]
                at = np.concatenate(best).astype(np.int32)
                near = np.concatenate([near, np.concatenate([np.take_along_axis(p, i, 1) for p, i in zip(parts, best, strict=True)])], 1)
                rows = np.concatenate([rows, at], 1)
                blocks = np.concatenate([blocks, np.full(at.shape, block.as_py())], 1)
                if near.shape[1] > rerank:
                    keep = np.argpartition(near, rerank - 1, 1)[:, :rerank]
                    near, rows, blocks = (np.take_along_axis(x, keep, 1) for x in (near, rows, blocks))
        if near.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (near, blocks, rows))], ["query", "near", "blocks", "rows"])

    return index.select("block", "n", "codes", "norms").mapInArrow(run, "query int, near binary, blocks binary, rows binary")


def _best(candidates: DataFrame, rerank: int) -> DataFrame:
    """(query, block, row): the `rerank` best of all tasks, merged one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, held = None, None

        def best() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), query, np.int32)), pa.array(held[1]), pa.array(held[2])], ["query", "block", "row"])

        for b in batches:
            for q, *parts in zip(*b.columns, strict=True):
                here = [np.frombuffer(x.as_py(), kind) for x, kind in zip(parts, (np.float32, np.int64, np.int32), strict=True)]
                if q.as_py() != query:
                    if held is not None:
                        yield best()
                    query, held = q.as_py(), here
                    continue
                held = [np.concatenate(x) for x in zip(held, here, strict=True)]
                if len(held[0]) > rerank:
                    keep = np.lexsort((held[2], held[1], held[0]))[:rerank]
                    held = [x[keep] for x in held]
        if held is not None:
            yield best()

    return candidates.repartition("query").sortWithinPartitions("query").mapInArrow(run, "query int, block long, row int")


def _exact(index: DataFrame, candidates: DataFrame, qids: np.ndarray, q: np.ndarray, kind: str) -> DataFrame:
    """(query_id, vec_id, score) for all ids of the candidates, from the stored vectors."""
    sent = index.sparkSession.sparkContext.broadcast((qids, q))
    wanted = candidates.groupBy("block").agg(F.collect_list(F.struct("query", "row")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        for b in batches:
            for n, vectors, ids, each, pairs in zip(*b.columns, strict=True):
                x = np.frombuffer(vectors.as_py(), np.dtype(kind)).reshape(n.as_py(), -1)
                ids, each = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(each.as_py(), np.int32)
                query, row = (pairs.values.field(c).to_numpy() for c in (0, 1))
                d = np.concatenate([distances(x[row[s : s + BLOCK]], q[query[s : s + BLOCK]]) for s in range(0, len(row), BLOCK)])
                m = each[row]
                at = np.arange(m.sum()) + np.repeat(np.cumsum(each)[row] - np.cumsum(m), m)
                who, found, d = np.repeat(qids[query], m), ids[at], np.repeat(d, m)
                other = who != found
                yield pa.RecordBatch.from_arrays([pa.array(who[other]), pa.array(found[other]), pa.array(d[other])], ["query_id", "vec_id", "score"])

    met = index.select("block", "n", "vectors", "ids", "each").join(wanted, "block").select("n", "vectors", "ids", "each", "wanted")
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = 8192, rerank: int = RERANK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that is_query holds for. Codebooks are fitted on `sample` rows."""
    spark = df.sparkSession
    kind = "float64" if "double" in df.schema[vector].dataType.simpleString() else "float32"
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    shape = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if shape is None or not shape["q"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == shape["dim"])
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    quantizer = AdditiveQuantizer().fit(_matrix(picked, np.float64))
    index, _ = materialize(spark, build(entries(rows, k), quantizer, kind), "codes")
    most = max(rerank, 2 * k)
    groups = -(-shape["q"] * (shape["dim"] + 1) * 8 // group_bytes)
    found = []
    for g in range(groups):
        asked = rows.where(F.col("asks") & (F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)).groupBy("vec_id").agg(F.min("embedding")).toArrow()
        if not asked.num_rows:
            continue
        qids, q = asked.column(0).to_numpy(), _matrix(asked.column(1).combine_chunks(), np.float64)
        part = _exact(index, _best(_candidates(index, quantizer, q, most), most), qids, q, kind)
        if groups > 1:
            part, _ = materialize(spark, part, "found")
        found.append(part)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
