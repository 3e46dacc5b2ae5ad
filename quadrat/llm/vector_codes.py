"""Vector codes: the parts of integer vectors replaced by entries of learned codebooks, by Lloyd rounds over cover trees.

Vectors lie in blocks of at most ``BLOCK`` rows, as the table's partitions hold them. A block has a cover tree per part: the
children of a node lie within half its radius, and a node knows its centre, its radius and the sum and number of its points.
The trees are built once and written; a round reads them. A node whose nearest entry stays nearest for every point within the
radius gives its sum and number to that entry as a whole (triangle inequality); the others pass their children down, and only
points of small nodes that stay undecided are compared one by one. All distances are integers, so ties are seen as such.
Entries move by the sums of all blocks, which are as many rows as there are entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from quadrat.session import stored

#: Rows of a block, and points of a tree node that is not divided.
BLOCK, LEAF = 4096, 24

#: Integer components must be smaller than this, so that errors and sums fit 64 bits.
LARGEST = 1 << 26


class CoverTree:
    """Nodes of one part's points. ``order`` lists the points so that each node has those from ``start`` to ``stop``."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.order, self.nodes, self.radius = points, order, nodes, radius
        self.centre, self.start, self.stop, self.first_child, self.children = nodes
        # the total of any stretch of points, and so of any node, is a difference of these
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], 0)])

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order = np.arange(len(points))
        nodes = [[0, 0.0, 0, len(points), 0, 0]]  # centre, squared radius, start, stop, first child, children
        if len(points):
            nodes[0][1] = _squares(points, points[0]).max()
        at = 0
        while at < len(nodes):
            centre, square, start, stop, _, _ = nodes[at]
            if stop - start > leaf and square > 0:
                own = order[start:stop]
                rest, distance, groups = own, _squares(points[own], points[centre]), []
                head = centre
                while len(rest):
                    near = distance * 4 <= square  # within half the radius
                    groups.append((head, rest[near], distance[near].max(initial=0)))
                    far = distance[~near]
                    rest = rest[~near]
                    if len(rest):
                        head = rest[far.argmax()]
                        distance = _squares(points[rest], points[head])
                nodes[at][4:] = [len(nodes), len(groups)]
                place = start
                for head, held, widest in groups:
                    order[place:place + len(held)] = held
                    nodes.append([head, widest, place, place + len(held), 0, 0])
                    place += len(held)
            at += 1
        table = np.array(nodes, np.int64)
        return cls(points, order, np.ascontiguousarray(table[:, [0, 2, 3, 4, 5]].T), np.sqrt(table[:, 1].astype(np.float64)) * (1 + 1e-9))

    def packed(self) -> bytes:
        return self.order.astype(np.int32).tobytes() + self.nodes.astype(np.int32).tobytes() + self.radius.tobytes()

    @classmethod
    def unpacked(cls, points: np.ndarray, data: bytes) -> CoverTree:
        n = len(points)
        nodes = (len(data) - 4 * n) // (4 * 5 + 8)
        table = np.frombuffer(data, np.int32, 5 * nodes, 4 * n).astype(np.int64).reshape(5, nodes)
        return cls(points, np.frombuffer(data, np.int32, n).astype(np.int64), table, np.frombuffer(data, np.float64, nodes, 4 * n + 20 * nodes))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the lower index) and its squared distance, for every point."""
        codes = np.zeros(len(self.points), np.int64)
        for starts, stops, found in self._decided(entries):
            spans = stops - starts
            at = np.repeat(starts - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            codes[self.order[at]] = np.repeat(found, spans)
        difference = self.points - entries[codes]
        return codes, (difference * difference).sum(1)

    def totals(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points nearest to each entry; decided nodes add theirs as a whole."""
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        for starts, stops, found in self._decided(entries):
            np.add.at(sums, found, self.sums[stops] - self.sums[starts])
            np.add.at(counts, found, stops - starts)
        return sums, counts

    def _decided(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches of ``order`` with the entry that all their points go to; together they are all points once."""
        if not len(self.points):
            return
        kept = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # of equal entries the first takes all
        frontier = np.array([0])
        while len(frontier):
            found, sure = nearest(self.points[self.centre[frontier]], entries, kept, self.radius[frontier])
            yield self.start[frontier[sure]], self.stop[frontier[sure]], found[sure]
            open_nodes = frontier[~sure]
            leaves = open_nodes[self.children[open_nodes] == 0]
            spans = self.stop[leaves] - self.start[leaves]
            at = np.repeat(self.start[leaves] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
            if len(at):
                single, _ = nearest(self.points[self.order[at]], entries, kept, None)
                yield at, at + 1, single
            inner = open_nodes[self.children[open_nodes] > 0]
            spans = self.children[inner]
            frontier = np.repeat(self.first_child[inner] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())


def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    difference = points - centre
    return (difference * difference).sum(1)


def nearest(points: np.ndarray, entries: np.ndarray, kept: np.ndarray, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the ``kept`` entries, the lower index at ties, and whether it is that of all points within ``radius`` too."""
    distance = np.zeros((len(points), len(kept)), np.int64)
    for j in range(points.shape[1]):
        difference = points[:, j, None] - entries[kept, j]
        distance += difference * difference
    first = distance.argmin(1)
    if radius is None:
        return kept[first], np.ones(len(points), bool)
    rows = np.arange(len(points))
    least = np.sqrt(distance[rows, first].astype(np.float64))
    if len(kept) == 1:
        return kept[first], np.ones(len(points), bool)
    distance[rows, first] = np.iinfo(np.int64).max
    second = np.sqrt(distance.min(1).astype(np.float64))
    single = radius == 0  # all points are the centre, so its tie is theirs
    return kept[first], single | (least * (1 + 1e-9) + radius < second * (1 - 1e-9) - radius)


def integers(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows whose vector is whole, with ``v``: its components times ``scale``, rounded down."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False)))
    return whole.withColumn("v", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blocks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Blocks of rows (vec_id, label, v) with the packed points and trees of each part; nothing is shuffled."""
    types = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField("ids", ArrayType(types["vec_id"])), StructField("labels", ArrayType(types["label"])),
                         StructField("points", BinaryType()), StructField("trees", ArrayType(BinaryType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                points = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, parts, width // parts)
                trees = [CoverTree.build(np.ascontiguousarray(points[:, p])).packed() for p in range(parts)]
                whole = pa.array([0, some.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(whole, some.column("vec_id")), pa.ListArray.from_arrays(whole, some.column("label")),
                     pa.array([points.astype(np.int32).tobytes()]), pa.array([trees])], schema.names)

    return stored(rows.select("vec_id", "label", "v").mapInArrow(build, schema), "trees")


def _trees(points: bytes, packed: list[bytes], parts: int, piece: int) -> list[CoverTree]:
    """The trees of a block's row."""
    block = np.frombuffer(points, np.int32).astype(np.int64).reshape(-1, parts, piece)
    return [CoverTree.unpacked(np.ascontiguousarray(block[:, p]), data) for p, data in enumerate(packed)]


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the rounded-down mean of its points, or itself if it has none."""
    parts, size, piece = books.shape

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(books), np.zeros((parts, size), np.int64)
        for df in frames:
            for points, packed in zip(df["points"], df["trees"]):
                for p, tree in enumerate(_trees(points, packed, parts, piece)):
                    s, c = tree.totals(books[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = (x.ravel() for x in np.indices((parts, size)))
        table = pd.DataFrame({"part": part, "entry": entry, "n": counts.ravel()})
        for j in range(piece):
            table[f"s{j}"] = sums[:, :, j].ravel()
        yield table[table["n"] > 0]

    names = [f"s{j}" for j in range(piece)]
    found = (blocks.select("points", "trees").mapInPandas(total, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
             .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names)))
    out = books.copy()
    for row in found.collect():  # one row per entry and part
        out[row.part, row.entry] = [int(row[c]) // row.n for c in names]
    return out


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vector: str = "embedding",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the final codebooks (parts x entries x width): vec_id, label, code, error.

    Components are taken times ``scale`` and rounded down. Vectors that are NULL or hold NULL or non-finite components are
    left out. The first codebooks are the parts of the ``entries`` smallest vec_ids (NULL ids last, equal ids by vector; all
    of them if they are fewer). ``code`` has two hex digits per part (``entries`` is 256 at most). Rows that repeat count each; labels may be NULL; other
    columns are not read. An empty table gives no rows and empty codebooks. Vectors of differing lengths, of a length that
    ``parts`` does not divide, or with components of ``LARGEST`` or more are an error.
    """
    rows = integers(vectors.select("vec_id", F.col(label).alias("label"), F.col(vector).alias("_x")), "_x", scale)
    facts = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"),
                     F.max(F.array_max(F.transform("_x", lambda x: F.abs(x.cast("double")) * scale))).alias("most")).first()
    schema = StructType([*rows.select("vec_id", "label").schema.fields, *StructType.fromDDL("code string, error long").fields])
    if facts.high is None or facts.high == 0:
        codes = rows.select("vec_id", "label", F.lit("00" * parts).alias("code"), F.lit(0).cast("long").alias("error"))
        return codes, np.zeros((parts, 0, 0), np.int64)
    if facts.low != facts.high or facts.high % parts:
        raise ValueError(f"vectors of {facts.low} to {facts.high} components cannot be cut into {parts} equal parts")
    if facts.most >= LARGEST - 1:
        raise ValueError("components are too large for whole numbers of 64 bits")
    piece = facts.high // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.ascontiguousarray(np.array([r.v for r in first], np.int64).reshape(-1, parts, piece).transpose(1, 0, 2))
    blocks = _blocks(rows, facts.high, parts)
    for _ in range(rounds):
        books = _moved(blocks, books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                trees = _trees(row.column("points")[0].as_py(), row.column("trees")[0].as_py(), parts, piece)
                codes, errors = zip(*(t.assign(books[p]) for p, t in enumerate(trees)))
                digits = [d.tobytes().hex() for d in np.stack(codes, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(digits, pa.string()),
                                                  pa.array(np.sum(errors, 0))], schema.names)

    return blocks.mapInArrow(encode, schema), books


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (sum of errors of the rows with this label, NULLs together), codebooks_sha256."""
    codes, books = compress(vectors, **options)
    codes = stored(codes, "codes")
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment to codebooks ``k``, and the codebooks after it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, p, CAST(best % 64 AS BIGINT) AS e, best // 64 AS d FROM (
    SELECT x.r, x.p, min(((x.x1 - c.x1) ** 2 + (x.x2 - c.x2) ** 2 + (x.x3 - c.x3) ** 2 + (x.x4 - c.x4) ** 2)::BIGINT * 64 + c.e) AS best
    FROM x JOIN c{k} c ON c.p = x.p GROUP BY x.r, x.p)),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, """ + ", ".join(f"CAST(coalesce(floor(m.x{j} / m.n), c.x{j}) AS BIGINT) AS x{j}" for j in (1, 2, 3, 4)) + f"""
  FROM c{k} c LEFT JOIN (
    SELECT x.p, a.e, count(*) AS n, """ + ", ".join(f"sum(x.x{j})::DOUBLE AS x{j}" for j in (1, 2, 3, 4)) + f"""
    FROM a{k} a JOIN x ON x.r = a.r AND x.p = a.p GROUP BY x.p, a.e) m ON m.p = c.p AND m.e = c.e)"""


#: The rows of ``code_digest`` on ``embeddings`` of 64 components with its default parameters.
SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
x AS MATERIALIZED (SELECT r, p, v[4 * p + 1] AS x1, v[4 * p + 2] AS x2, v[4 * p + 3] AS x3, v[4 * p + 4] AS x4 FROM kept, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x1, x2, x3, x4 FROM x WHERE r <= 64),""" + _round_sql(0) + "," + _round_sql(1) + "," + _round_sql(2).split(",\nc3 AS")[0] + """,
book AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
coded AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r, book b
"""
