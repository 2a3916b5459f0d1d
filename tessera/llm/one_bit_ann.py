"""Approximate nearest neighbours with randomly rotated one-bit codes (operator 8).

Index. Cells are fitted on a sample of at most ``SAMPLE`` rows (k-means); a row belongs to
its nearest centre. Its difference from the centre is rotated into ``LENGTHEN`` times as
many dimensions by a random matrix with orthonormal columns and kept as its signs, packed,
with three scalars: its length, the inner product of its direction with its code, and how far
the code, turned back, is from that direction. The last gives the error of an estimate for a
query that lies anyhow: ``EPSILON`` standard deviations are its bound.

Search. A query looks into the cells whose centres have the largest inner products with it:
as many as it takes on the sample for ``TARGET`` of the true neighbours there (few where
vectors cluster, most where they don't). Its floor starts at the k-th best exact score in the
sample. A task unpacks the codes of one block of cells, estimates the inner products of a
block of queries by one matrix product, and returns ids whose upper bound reaches the floor
and the k-th best lower bound of the block. The k-th best lower bound of all blocks cuts
these once more; only then are vectors fetched, by id, and scored exactly.

Scale. Before that only codes and scalars are shuffled, no stored vector: blocks hold about
``DATA_BLOCK`` rows of neighbouring cells (a large cell is dealt into several by a hash), and
a block that many queries visit is met by them in blocks of ``QUERY_BLOCK``. Of equal vectors
just the k + 1 smallest ids can be neighbours, so a group of copies is cut to these by a
window that Spark limits before its shuffle; equal queries are searched once. Centres (at most
``MAX_CELLS``), their row counts and the sample are what the driver and every task hold.

Cases: vectors that are null, zero, hold null or non-finite numbers, or have another
dimension than most take no part, as query or candidate, nor do rows without an id.
Queries that repeat an id are one query (the smallest vector); candidates that repeat
an id are each returned, but none with the query's own id. Fewer than k candidates in the
cells looked into are all returned, none gives no rows; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_small, materialize

SAMPLE = 40_000          # rows that centres, probes and floors are taken from
CELL_ROWS = 512          # rows of a cell, if that needs no more than
MAX_CELLS = 1024
TRIED = 300              # sample rows that set the number of cells to look into
TARGET = 0.97            # share of their neighbours that these must hold
LENGTHEN = 8             # code bits for each dimension
EPSILON = 2.4            # bound in standard deviations of the estimate
DATA_BLOCK = 8192
QUERY_BLOCK = 2048
AT_ONCE = 256            # queries of one matrix product


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """A random [bits, dim] matrix with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return q * np.sign(np.diag(r))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every vector."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, int), *[(half - vectors[i:i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(vectors), 4096)]])


def kmeans(vectors: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    centres = vectors[rnd.choice(len(vectors), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(vectors, centres)
        n = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, vectors[:, j], minlength=k) for j in range(vectors.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Cells:
    """What every task knows: the rotation, the centres, how many of them a query looks into,
    the sample, and the first block and number of blocks of each cell."""
    rotate: np.ndarray
    centres: np.ndarray
    probes: int
    sample: np.ndarray
    first: np.ndarray | None = None
    blocks: np.ndarray | None = None

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cells, packed codes [n, bits / 8], lengths, inner products with the own code, errors."""
        cell = nearest(vectors, self.centres)
        r = vectors - self.centres[cell]
        norm = np.linalg.norm(r, axis=1)
        unit = r / np.where(norm > 0, norm, 1.0)[:, None]
        turned = unit @ self.rotate.T
        bits = turned > 0
        root = np.sqrt(turned.shape[1])
        own = np.where(norm > 0, np.abs(turned).sum(axis=1) / root, 1.0)
        back = np.where(bits, 1.0, -1.0) @ self.rotate / (root * own)[:, None]
        error = np.where(norm > 0, np.linalg.norm(back - unit, axis=1), 0.0) / np.sqrt(max(vectors.shape[1] - 1, 1))
        return cell, np.packbits(bits, axis=1, bitorder="little"), norm, own, error

    def estimate(self, queries: np.ndarray, cell, codes, norm, own, error) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products [query, row] and their error bounds."""
        n = self.rotate.shape[0]
        signs = np.unpackbits(codes, axis=1, count=n, bitorder="little").astype(np.float32) * 2 - 1
        turned = (queries @ self.rotate.T).astype(np.float32)
        guess = (queries @ self.centres.T)[:, cell] + (turned @ signs.T) * (norm / (own * np.sqrt(n)))
        return guess, EPSILON * np.linalg.norm(queries, axis=1)[:, None] * (norm * error)

    def looked_into(self, queries: np.ndarray) -> np.ndarray:
        """Whether a query [i] looks into a cell [j]."""
        score = queries @ self.centres.T
        if self.probes >= score.shape[1]:
            return np.ones(score.shape, bool)
        return score >= -np.partition(-score, self.probes - 1, axis=1)[:, self.probes - 1:self.probes]

    def floors(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score in the sample, which no k-th best of all rows is below; less a
        little, as it is compared with sums in another order."""
        if len(self.sample) < k:
            return np.full(len(queries), -np.inf)
        best = np.concatenate([np.zeros(0), *[np.partition(queries[i:i + 1024] @ self.sample.T, -k, axis=1)[:, -k]
                                              for i in range(0, len(queries), 1024)]])
        return best - 1e-6 * np.abs(best)


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """How many cells, by inner product with the centre, hold ``target`` of the k best of
    ``TRIED`` sample rows in the sample."""
    tried = sample[:: max(1, len(sample) // TRIED)]
    scores = tried @ sample.T
    best = np.argpartition(-scores, min(k, len(sample) - 1), axis=1)[:, :k + 1]
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, nearest(sample, centres)[best], axis=1).ravel())
    return int(found[min(len(found) - 1, ceil(target * len(found)) - 1)]) + 1


def usable(vector: Column | str, dim: int) -> Column:
    """True where a vector has ``dim`` finite numbers that are not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(b: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = b.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(b.num_rows, -1)


def _digests(column: pa.Array) -> list[bytes]:
    """A digest of every vector, equal for equal ones."""
    flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0)
    return [md5(v.tobytes()).digest() for v in flat.reshape(len(column), -1)]


def _coded(cells, batches):
    """(id, digest, cell, code, norm, own, error) of every row."""
    for b in batches:
        if b.num_rows:
            cell, codes, *scalars = cells.value.encode(_vectors(b, "vector"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(_digests(b.column("vector")), pa.binary()), pa.array(cell.astype(np.int32)),
                 pa.array([c.tobytes() for c in codes], pa.binary()), *[pa.array(s.astype(np.float32)) for s in scalars]],
                names=["id", "digest", "cell", "code", "norm", "own", "error"])


def _sent(cells, k: int, batches):
    """(query, vector, floor, blocks) of every query: the blocks with a cell that it looks into."""
    for b in batches:
        if b.num_rows:
            c, v = cells.value, _vectors(b, "vector")
            there = [np.unique(np.concatenate([np.arange(c.first[j], c.first[j] + c.blocks[j]) for j in np.flatnonzero(row)]))
                     for row in c.looked_into(v)]
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("vector"), pa.array(c.floors(v, k)),
                                              pa.array(there, pa.list_(pa.int32()))], names=["query", "vector", "floor", "block"])


def _scan(cells, k: int, queries: pa.Table, rows: pa.Table) -> pa.Table:
    """(query, id, low, high): what may be among the k best of a block, with bounds of its score."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
    if rows.num_rows and queries.num_rows:
        c, q_ids, v = cells.value, queries.column("query").to_numpy(), _vectors(queries, "vector")
        floor, ids, cell = queries.column("floor").to_numpy(), rows.column("id").to_numpy(), rows.column("cell").to_numpy()
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        scalars = [rows.column(n).to_numpy().astype(np.float64) for n in ("norm", "own", "error")]
        for i in range(0, len(q_ids), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            guess, bound = c.estimate(v[part], cell, codes, *scalars)
            seen = c.looked_into(v[part])[:, cell]
            low = np.where(seen, guess - bound, -np.inf)
            least = floor[part]
            if low.shape[1] >= k:
                least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
            query, row = np.nonzero(seen & (guess + bound >= least[:, None]))
            for column, made in zip(out, (q_ids[part][query], ids[row], low[query, row], (guess + bound)[query, row])):
                column.append(made)
    return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query", "id", "low", "high"), out)})


class OneBitIndex:
    """An index of every usable row of a table of vectors."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, k: int = 20,
                 target: float = TARGET):
        """``k``: neighbours that the cells to look into are chosen for."""
        v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL")
        sizes = v.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.dim = sizes["d"] if sizes else 1
        self.rows = v.where(usable("vector", self.dim))
        self.count = self.rows.count()
        draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
        share = min(1.0, 0.9 * SAMPLE / max(self.count, 1))
        chosen = self.rows.where(draw < share * 1_000_000).groupBy("vector").agg(F.min("id").alias("id")) \
            .orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        sample = _vectors(chosen, "vector") if chosen.num_rows else np.zeros((0, self.dim))
        bits = -(-LENGTHEN * self.dim // 64) * 64
        few = max(1, min(len(sample), MAX_CELLS, round(self.count / CELL_ROWS)))
        centres = kmeans(sample, few, seed) if len(sample) else np.zeros((1, self.dim))
        probes = probes_needed(sample, centres, k, target) if len(sample) else 1
        self.cells = Cells(rotation(self.dim, bits, seed), centres, probes, sample)
        send = rows.sparkSession.sparkContext.broadcast(self.cells)
        self.codes = materialize(self.rows.mapInArrow(
            lambda batches: _coded(send, batches), "id long, digest binary, cell int, code binary, norm float, own float, error float"), "codes")

    def candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, id) for what may be among the ``k`` best of each row of ``queries`` (query,
        vector), the query's own row included: those whose bounds say so."""
        context = queries.sparkSession.sparkContext
        copies = Window.partitionBy("digest").orderBy("id")
        codes = self.codes.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy", "digest")
        held = {r["cell"]: r["count"] for r in self.codes.groupBy("cell").count().collect()}
        first, blocks, at, room = [], [], -1, 0
        for j in range(len(self.cells.centres)):
            n = held.get(j, 0)
            if n > room or at < 0:
                at, room = at + 1, DATA_BLOCK
            parts = max(1, ceil(n / DATA_BLOCK))
            first.append(at)
            blocks.append(parts)
            at, room = at + parts - 1, room - n if parts == 1 else 0
        cells = Cells(self.cells.rotate, self.cells.centres, self.cells.probes, self.cells.sample, np.array(first), np.array(blocks))
        send = context.broadcast(cells)
        sent = materialize(queries.mapInArrow(lambda batches: _sent(send, k, batches),
                                              f"query long, vector {dict(queries.dtypes)['vector']}, floor double, block array<int>"), "sent")
        visits = {r["b"]: ceil(r["count"] / QUERY_BLOCK) for r in sent.select(F.explode("block").alias("b")).groupBy("b").count().collect()}
        table = queries.sparkSession.createDataFrame(
            [(j, f, n, [visits.get(b, 0) for b in range(f, f + n)]) for j, (f, n) in enumerate(zip(first, blocks))],
            "cell int, first int, parts int, visits array<int>")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        right = codes.join(F.broadcast(table), "cell").withColumn("part", part).withColumn("block", F.col("first") + F.col("part")) \
            .withColumn("share", F.explode(F.filter(F.sequence(F.lit(0), F.col("visits")[F.col("part")]), lambda s: s < F.col("visits")[F.col("part")]))) \
            .select("block", "share", "id", "cell", "code", "norm", "own", "error")
        many = queries.sparkSession.createDataFrame(list(visits.items()), "block int, many int")
        left = sent.withColumn("block", F.explode("block")).join(broadcast_small(many), "block")
        left = left.select("block", F.pmod(F.xxhash64("query"), F.col("many")).cast("int").alias("share"), "query", "vector", "floor")
        found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(
            lambda q, r: _scan(send, k, q, r), "query long, id long, low double, high double")
        by_low = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
        floor = F.max(F.when(F.col("place") == k, F.col("low"))).over(Window.partitionBy("query"))
        return found.withColumn("place", by_low).withColumn("least", floor) \
            .where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query", "id").distinct()

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, rank, vec_id, score): the k candidates with the largest inner product
        for each row of ``queries`` (id, vector)."""
        asked = queries.where(F.col("id").isNotNull() & usable("vector", self.dim)).groupBy("id").agg(F.min("vector").alias("vector"))
        asked = materialize(asked, "queries")
        once = materialize(asked.groupBy("vector").agg(F.min("id").alias("query")), "queries")   # equal queries are searched once
        chosen = self.candidates(once, k + 1)                    # one more, as the own row may be among them
        scored = chosen.join(self.rows, "id").join(once.withColumnRenamed("vector", "asked"), "query") \
            .select("query", "id", F.aggregate(F.zip_with("vector", "asked", lambda a, b: a.cast("double") * b.cast("double")),
                                               F.lit(0.0), lambda s, x: s + x).alias("score"))
        order = [F.desc("score"), F.asc("id")]
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))) \
            .where(F.col("place") <= k + 1).drop("place")
        each = asked.join(once, "vector").select(F.col("id").alias("query_id"), "query").join(best, "query") \
            .where(F.col("id") != F.col("query_id"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
