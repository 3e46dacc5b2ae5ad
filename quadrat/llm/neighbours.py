"""Nearest neighbours by largest inner product, with multi-index hashing of learned binary codes.

Vectors are brought to one length by an added component, so that a larger inner product is a smaller angle. Rotations learned
on a bounded sample (iterative quantization) turn each vector into a code of ``BITS`` bits, which is cut into substrings of
``PART`` bits. Each index block holds a table per substring from its value to the rows that have it. A code within Hamming
radius m * t + a - 1 of the query differs by at most t bits in one of the first a substrings of m, or by less in one of the
others (pigeonhole), so probing substring values at distance 0, 1, ..., t, substring after substring, finds every such code.
Probing goes on until ``POOL`` codes lie within the radius that is complete; these are ranked again on the original vectors in
double precision.

Equal vectors are one index entry with its smallest ids, as many as a result can hold: more of them cannot be in any result.
Index blocks and query blocks meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.session import stored

BITS, PART = 128, 8

#: Vectors that the rotations are learned on, and rounds of learning.
SAMPLE, ROUNDS = 5000, 15

#: Entries of an index block, queries of a query block, and codes per index block that are ranked again.
INDEX_BLOCK, QUERY_BLOCK, POOL = 16_384, 512, 1536

#: Substrings that are probed at one distance before the codes found are counted.
TOGETHER = 8

#: Substring values by number of bits set: probes at distance t are the value XOR these.
_FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(PART), t)], np.int64) for t in range(PART + 1)]


def usable(vector: str) -> Column:
    """Neither NULL nor zero, and every component a finite number."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def learn_rotations(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """A (dimensions x bits) matrix of rotations side by side, each fitted to bring the sample close to its signs."""
    rng, width, parts = np.random.default_rng(seed), sample.shape[1], []
    while sum(p.shape[1] for p in parts) < bits:
        rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(sample @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(sample.T @ signs)
            rotation = u @ vt
        parts.append(rotation)
    return np.concatenate(parts, 1)[:, :bits]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors of one more dimension whose angles order inner products with a query."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Code bytes, one per substring."""
    return np.packbits(x @ rotations >= 0, axis=1)


class IndexBlock:
    """Substring tables of one block of codes."""

    def __init__(self, block: np.ndarray):
        self.codes = block
        self.wide = np.ascontiguousarray(np.ascontiguousarray(block).view(np.uint64).T)
        self.buckets = []
        for k in range(block.shape[1]):
            order = np.argsort(block[:, k], kind="stable")
            self.buckets.append(np.split(order, np.searchsorted(block[order, k], np.arange(1, 1 << PART))))

    def within(self, code: np.ndarray, pool: int) -> np.ndarray:
        """Rows of every code within a Hamming radius that holds ``pool`` codes, or of all codes.

        Once some substrings are probed at distance t and the other ones at t - 1, codes not seen yet differ by more than
        m * t + (number of the former) - 1 bits. So probing ends between two distances, ``TOGETHER`` substrings at a time.
        """
        n, parts = self.codes.shape
        if pool >= n:
            return np.arange(n)
        wide = np.ascontiguousarray(code).view(np.uint64)
        seen, distance = np.zeros(n, bool), np.full(n, 1 << 15, np.int64)
        number = np.zeros(PART * parts + 1, np.int64)  # codes seen, by distance
        for t, flips in enumerate(_FLIPS):
            for first in range(0, parts, TOGETHER):
                some = range(first, min(first + TOGETHER, parts))
                fresh = np.zeros(n, bool)
                fresh[np.concatenate([self.buckets[k][value] for k in some for value in (int(code[k]) ^ flips).tolist()])] = True
                rows = np.flatnonzero(fresh & ~seen)
                seen[rows] = True
                far = sum(np.bitwise_count(column[rows] ^ part).astype(np.int64) for column, part in zip(self.wide, wide))
                distance[rows] = far
                number += np.bincount(far, minlength=len(number))
                held = np.cumsum(number[:parts * t + some[-1] + 1])
                if held[-1] >= pool:
                    return np.flatnonzero(distance <= np.searchsorted(held, pool))
        return np.arange(n)


def _vectors(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    lengths = lists.value_lengths().to_numpy()
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), -1)


def _best(x: np.ndarray, near: np.ndarray, row: np.ndarray, count: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows ``near`` that can be among the ``count`` largest inner products, with the exact products. ``slack`` is more
    than twice the error of a product summed in any order."""
    if len(near) > 2 * count:
        rough = x[near] @ row
        near = near[rough >= np.partition(rough, len(rough) - count)[len(rough) - count] - slack]
    return near, exact_products(x[near], row)


def search(index: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", pool: int = POOL, index_block: int = INDEX_BLOCK) -> DataFrame:
    """For each query row (vec_id, vector) its ``k`` nearest rows of ``index``: query_id, rank, vec_id, score.

    A row is no candidate of a query with its own vec_id. Ties go to the smaller vec_id; fewer candidates give fewer rows.
    Vectors that are NULL, zero or hold NULL or non-finite components take no part. Rows that repeat a vec_id with one
    vector count once; vectors of other lengths than the most common one are an error.
    """
    kinds = "array<double>"
    rows = index.where(usable(vector)).select("vec_id", F.col(vector).cast(kinds).alias("v"))
    asked = queries.where(usable(vector)).select(F.col("vec_id").alias("query_id"), F.col(vector).cast(kinds).alias("v"))
    ids = F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1)
    place = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.distinct().withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k + 1).groupBy("v").agg(ids.alias("ids")))
    entries = stored(entries, "entries")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = entries.agg(F.count("*").alias("n"), F.max(size).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts.n:
        return index.sparkSession.createDataFrame([], schema)
    longest = float(np.sqrt(facts.most)) * (1 + 1e-12)
    sample = entries.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").collect()
    rotations = learn_rotations(lifted(np.array([r.v for r in sample]), longest))
    blocks = -(-facts.n // index_block)
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = entries.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), "v", "ids")
    left = left.groupBy("block").agg(F.collect_list(F.struct("v", "ids")).alias("entries"))  # bounded by the block size
    right = asked.distinct().select(F.pmod(F.xxhash64("query_id", "v"), F.lit(query_blocks)).alias("asked"), "v", "query_id")
    right = right.groupBy("asked").agg(F.collect_list(F.struct("v", "query_id")).alias("queries"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = right.join(left, "block").repartition(max(1, min(4096, blocks * query_blocks)), "block", "asked")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, those in zip(*(batch.column(c) for c in ("entries", "queries"))):
                (vectors, ids), (asked_for, own_ids) = some.values.flatten(), those.values.flatten()
                x, q = _vectors(vectors), _vectors(asked_for)
                stops, held = np.cumsum(ids.value_lengths().to_numpy()), ids.flatten().to_numpy().tolist()
                starts = np.append(0, stops[:-1]).tolist()
                stops = stops.tolist()
                block = IndexBlock(codes(lifted(x, longest), rotations))
                sizes = np.sqrt((q * q).sum(1, keepdims=True))
                slacks = (sizes.ravel() * longest * 1e-14 * (x.shape[1] + 8)).tolist()
                out = []
                for row, code, own, slack in zip(q, codes(np.concatenate([q / sizes, np.zeros((len(q), 1))], 1), rotations), own_ids.to_pylist(), slacks):
                    near, score = _best(x, block.within(code, pool), row, 2 * k, slack)  # ties of the last kept score stay
                    out += [(own, i, -s) for s, i in sorted((-s, i) for s, e in zip(score.tolist(), near.tolist()) for i in held[starts[e]:stops[e]] if i != own)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                                                 names=["query_id", "vec_id", "score"])

    found = pairs.select("entries", "queries").mapInArrow(probe, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_products(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * row[j]
    return total
