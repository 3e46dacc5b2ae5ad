"""Community matrices in sparse long form: ``(sample, taxon, count)`` with absent cells meaning zero."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions.grouping import dealt, number_keys
from quadrat.operators.summary import share_of_max, share_of_total
from quadrat.operators.wrangle import top_k
from quadrat.session import stored

RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")

BLOCK_SAMPLES = (256, 2048)  # samples per side of a distance tile, at least and at most
BLOCK_CELLS = 1_000_000      # values per side of a distance tile, about
CHUNK_TAXA = 16_384          # values of one sample in a tile, about
MOST_PARTS = 64              # partitions of the blocks that meet each other
DENSE_BYTES = 64 << 20       # matrices of a tile; more taxa follow one after the other
MEETINGS = 2_000_000         # pairs of values of one taxon that a tile adds at once
AT_ONCE = 1 << 17            # pairs whose parts of one taxon are added at once
FRAGMENT_CELLS = 1_000_000   # cells that a task packs at once before they are shuffled
HELD_CELLS = 4_000_000       # cells of the unpacked blocks that a task keeps
SAMPLE_SETS = 1 << 16        # hashed sets of samples whose values are counted together
PAIRS_AT_ONCE = 200_000      # pairs of a tile that leave it at once


def tax_glom(counts: DataFrame, taxonomy: DataFrame, rank: str, ranks: Sequence[str] = RANKS, na_rm: bool = True,
             sample: str = "sample_id", taxon: str = "taxon_id", count: str = "count", parts: int | None = None) -> DataFrame:
    """Sum the counts of taxa that share the path down to ``rank``.

    Counts are summed per taxon and sample first, so a taxonomy too large to broadcast meets combined rows only.
    Unassigned taxa are dropped if ``na_rm``; ranks below are left out, as they are no longer defined. ``parts``: partitions of the
    counts when they meet the taxonomy and when they are summed, for more of them than Spark's number suits.
    """
    path = list(ranks[: list(ranks).index(rank) + 1])
    known = taxonomy.select(taxon, *path)
    if na_rm:
        known = known.filter(F.col(rank).isNotNull() & (F.col(rank) != ""))
    once = counts.groupBy(sample, taxon).agg(F.sum(count).alias(count))
    summed = dealt(dealt(once, parts, taxon).join(known, taxon), parts, sample, *path)
    return summed.groupBy(sample, *path).agg(F.sum(count).alias(count))


def subset_samples(counts: DataFrame, samples: DataFrame, condition, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Filter the sample table and keep the counts of the samples that stay."""
    kept = samples.filter(condition)
    return counts.join(kept.select(sample), sample, "left_semi"), kept


def taxa_sums(counts: DataFrame, taxon: str = "taxon_id", count: str = "count") -> DataFrame:
    return counts.groupBy(taxon).agg(F.sum(count).alias("total"))


def top_taxa(counts: DataFrame, k: int = 10, taxon: str = "taxon_id", count: str = "count") -> DataFrame:
    """The counts of the k taxa with the largest totals."""
    best = top_k(counts, taxon, count, k)
    return counts.join(F.broadcast(best.select(taxon)), taxon, "left_semi")  # k rows


def top_taxa_by_group(counts: DataFrame, samples: DataFrame, group: str, k: int = 10, sample: str = "sample_id",
                      taxon: str = "taxon_id", count: str = "count") -> DataFrame:
    """Abundance of the top taxa per sample group: the numbers behind a stacked bar plot."""
    per_sample = top_taxa(counts, k, taxon, count).groupBy(sample, taxon).agg(F.sum(count).alias(count))
    return (per_sample.join(samples.select(sample, group), sample)
            .groupBy(group, taxon).agg(F.sum(count).alias("abundance")))


def standardize(df: DataFrame, method: str = "total", margin: int = 1, sample: str = "sample_id",
                variable: str = "taxon_id", value: str = "count", name: str = "share") -> DataFrame:
    """Divide by the total or the maximum of the sample (margin 1) or of the variable (margin 2)."""
    group = [sample] if margin == 1 else [variable]
    if method == "total":
        return share_of_total(df, group, value, name)
    if method == "max":
        return share_of_max(df, group, value, name)
    raise ValueError(f"unknown method {method!r}")


class Cells:
    """What a distance set is computed from: ``table`` (_id, _variable, _x) holds the known values, and ``metric`` says how. Several values of
    one cell are added up where cells are packed. Operators that only reduce distances take these, so that no pair is ever written."""

    def __init__(self, df: DataFrame, sample: str, variable: str, value: str, metric: str):
        key = F.col(sample)
        if isinstance(df.schema[sample].dataType, T.FractionalType):  # -0.0 and 0.0 are one sample
            key = F.when(key == 0, F.lit(0).cast(df.schema[sample].dataType)).otherwise(key)
        known = df.filter(F.col(value).isNotNull()).select(key.alias("_id"), F.col(variable).alias("_variable"), F.col(value).cast("double").alias("_x"))
        self.table, self.metric = stored(known, "cells", "zstd"), metric
        if not isinstance(df.schema[variable].dataType, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)):
            codes = number_keys(self.table, "_variable", "_code")  # a NULL variable has no number and takes 0
            self.table = self.table.join(codes, "_variable", "left").select("_id", F.coalesce("_code", F.lit(0)).alias("_variable"), "_x")

    @cached_property
    def sizes(self):
        """About how many samples, cells and variables there are."""
        return self.table.agg(F.approx_count_distinct("_id").alias("samples"), F.count(F.lit(1)).alias("cells"),
                              F.approx_count_distinct("_variable").alias("variables")).first()

    def largest(self, enough: int) -> int:
        """Values of the sample that has most of them, or a bound on them that is below ``enough``. Samples are counted in hashed sets first."""
        sets = F.pmod(F.xxhash64("_id"), F.lit(SAMPLE_SETS))
        counted = self.table.groupBy(sets.alias("_set")).agg(F.count(F.lit(1)).alias("c"))
        heavy = [r._set for r in counted.where(F.col("c") > enough).collect()]
        if not heavy:
            return enough
        return self.table.where(sets.isin(heavy)).groupBy("_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]


def squeezed(values: np.ndarray, kinds: Sequence[type]) -> bytes:
    """``values`` in the first of ``kinds`` that holds each of them exactly, compressed."""
    kind = np.dtype(values.dtype)
    with np.errstate(all="ignore"):
        for k in kinds:
            if np.array_equal(values.astype(k), values):
                kind = np.dtype(k)
                break
    raw = np.ascontiguousarray(values.astype(kind)).tobytes()
    return kind.char.encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def released(data) -> np.ndarray:
    """The values that ``squeezed`` took, in the kind that it chose."""
    view = memoryview(data)
    raw = pa.decompress(pa.py_buffer(view[9:]), decompressed_size=int.from_bytes(view[1:9], "little"), codec="zstd")
    return np.frombuffer(raw, np.dtype(bytes(view[:1]).decode()))


def _named(names: pa.Array) -> bytes:
    """Distinct names in order, a NULL last, compressed; whole numbers as their gaps."""
    if pa.types.is_integer(names.type):
        known = names.drop_null().cast(pa.int64()).to_numpy()
        return b"I" + bytes([names.null_count]) + squeezed(np.diff(known, prepend=0), (np.uint8, np.uint16, np.uint32))
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([names], names=["name"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return b"O" + sink.getvalue().to_pybytes()


def _names_of(data) -> pa.Array:
    view = memoryview(data)
    if bytes(view[:1]) == b"I":
        return pa.concat_arrays([pa.array(np.cumsum(released(view[2:]), dtype=np.int64)), pa.nulls(view[1], pa.int64())])
    return pa.ipc.open_stream(pa.py_buffer(view[1:])).read_all()["name"].combine_chunks()


_PACKED = ("names", "row", "code", "x")


def _pack(ids: pa.Array, names: pa.Array, x: pa.Array) -> dict:
    """Cells (sample, variable, value) as one row: ids in order, and cells in the order of their variables. A cell of no value is only a
    sample that is there; values of one cell are added up."""
    def coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
        found = values.dictionary_encode("encode")
        order = pc.sort_indices(found.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        return found.dictionary.take(order), rank[found.indices.to_numpy()]

    ids, row = coded(ids)
    there = x.is_valid().to_numpy(zero_copy_only=False)
    names, code = coded(names.filter(pa.array(there)))
    row, x = row[there], x.drop_null().to_numpy()
    key = code * len(ids) + row
    order = np.argsort(key, kind="stable")
    key, x = key[order], x[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    if len(first) < len(key):
        key, x = key[first], np.add.reduceat(x, first)
    code, row = np.divmod(key, max(len(ids), 1))
    return {"ids": ids, "names": _named(names), "row": squeezed(row, (np.uint8, np.uint16, np.uint32)),
            "code": squeezed(np.diff(code, prepend=0), (np.uint8, np.uint16, np.uint32)), "x": squeezed(x, (np.uint8, np.uint16, np.uint32, np.float32))}


class Block:
    """The cells of some samples: variables ``names`` in order, and per cell its sample's place ``row``, its variable's place ``code`` (in
    order) and its value ``x``, as whole numbers of a narrow kind where all values are such; ``total`` of each of the ``n`` samples."""

    def __init__(self, names: pa.Array, row: np.ndarray, code: np.ndarray, x: np.ndarray, n: int):
        self.names, self.row, self.code, self.x, self.n = names, row, code, x, n
        self.total = np.bincount(row, x, n).astype(float)  # of no cells numpy gives whole numbers
        self.whole = x.dtype.kind == "u"

    @classmethod
    def of(cls, names, row, code, x, n: int) -> Block:
        return cls(_names_of(names), released(row).astype(np.int64), np.cumsum(released(code), dtype=np.int64), released(x), n)


class Blocks:
    """Unpacks blocks of rows (columns with a suffix) and keeps the last ones, as a block meets others one after the other."""

    def __init__(self, key: Sequence[str], set_: int | str = ""):
        self.key, self.set_, self.held, self.size = key, set_, OrderedDict(), 0

    def of(self, row: dict, side: str) -> Block:
        name = tuple(row[f"{k}_{side}"].as_py() for k in self.key)
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        block = Block.of(*(row[f"{c}{self.set_}_{side}"].as_buffer() for c in _PACKED), len(row[f"ids{self.set_}_{side}"].values))
        self.held[name] = block
        self.size += len(block.x)
        while self.size > HELD_CELLS and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1].x)
        return block


def packed(cells: DataFrame, by: Sequence[str], id_type: T.DataType) -> DataFrame:
    """One row per group ``by`` of (_id, _variable, _x): its ids in order, and its cells packed. A NULL value is no cell.

    A partition packs what it has of each group before anything is shuffled, and the pieces of a group are packed again.
    """
    group, most = list(by), FRAGMENT_CELLS
    schema = T.StructType([*(cells.schema[c] for c in group), T.StructField("ids", T.ArrayType(id_type)),
                           *(T.StructField(c, T.BinaryType()) for c in _PACKED)])

    def row_of(key: Sequence, ids: pa.Array, names: pa.Array, x: pa.Array, kinds: pa.Schema) -> list[pa.Array]:
        made = _pack(ids, names, x)
        return [*(pa.array([k], kinds.field(c).type) for k, c in zip(key, group)), pa.ListArray.from_arrays([0, len(made["ids"])], made["ids"]),
                *(pa.array([made[c]], pa.binary()) for c in _PACKED)]

    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by([(c, "ascending") for c in group]).combine_chunks()
        keys = np.stack([table[c].to_numpy() for c in group])
        first = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for at, to in zip(first, np.append(first[1:], table.num_rows)):
            ids, names, x = (table[c].slice(at, to - at).combine_chunks() for c in ("_id", "_variable", "_x"))
            yield pa.record_batch(row_of(keys[:, at].tolist(), ids, names, x, table.schema), names=schema.names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield from cut(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from cut(pa.Table.from_batches(held))

    def whole(table: pa.Table) -> pa.Table:
        if table.num_rows == 1:
            return table
        parts = []
        for k in range(table.num_rows):
            ids = table["ids"][k].values
            block = Block.of(*(table[c][k].as_buffer() for c in _PACKED), len(ids))
            # A piece names every sample once without a value, as it may have samples without any.
            parts.append((pa.concat_arrays([ids, ids.take(pa.array(block.row))]), pa.concat_arrays([pa.nulls(len(ids), block.names.type), block.names.take(pa.array(block.code))]),
                          pa.concat_arrays([pa.nulls(len(ids), pa.float64()), pa.array(block.x.astype(float))])))
        ids, names, x = (pa.concat_arrays(v) for v in zip(*parts))
        return pa.table(row_of([table[c][0].as_py() for c in group], ids, names, x, table.schema), names=schema.names)

    return cells.select(*group, "_id", "_variable", "_x").mapInArrow(pieces, schema).groupBy(*group).applyInArrow(whole, schema)


def crossed(blocks: DataFrame, count: int, order: Sequence[str], condition) -> DataFrame:
    """Pairs of rows of a stored table, columns with the suffixes _a and _b. Partitions meet in a Cartesian product, which reads each of them
    again for every other one: nothing is replicated by a shuffle, however many blocks a block meets."""
    busy = math.isqrt(8 * blocks.sparkSession.sparkContext.defaultParallelism) + 1
    parts = max(1, min(count, MOST_PARTS, max(busy, count // 3)))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{e}") for c in blocks.columns]).repartitionByRange(parts, *[f"{c}_{e}" for c in order])
            for e in "ab")
    return a.hint("shuffle_replicate_nl").join(b, condition)


def tile_sums(a: Block, b: Block, metric: str) -> np.ndarray:
    """For each row of block ``a`` and of block ``b`` the part of the distance that their cells have together."""
    place = pc.index_in(b.names, value_set=a.names).fill_null(-1).to_numpy().astype(np.int64)
    if metric != "bray":
        alone = place < 0
        place[alone] = len(a.names) + np.arange(alone.sum())
        return _squared_gaps(a, b, place[b.code], len(a.names) + int(alone.sum()))
    # A shared part needs the taxon on both sides.
    shared = np.sort(place[place >= 0])
    new = np.full(len(a.names) + 1, -1)
    new[shared] = np.arange(len(shared))
    sides = []
    for block, code in ((a, new[a.code]), (b, new[place[b.code]])):
        keep = code >= 0
        sides.append((block.row[keep], code[keep], block.x[keep]))
    met = int(np.bincount(sides[0][1], minlength=len(shared)) @ np.bincount(sides[1][1], minlength=len(shared)))
    if met * 20 < len(shared) * a.n * b.n or any((x < 0).any() for *_, x in sides):  # few meet: cell by cell
        return _met_parts(*sides, a.n, b.n)
    # No sum of shared parts is above the smaller total, which tells how narrow a kind of whole numbers is safe.
    bound = min(a.total.max(), b.total.max()) if a.whole and b.whole else np.inf
    kind = np.uint16 if bound < 1 << 16 else np.uint32 if bound < 1 << 32 else np.float64
    if kind is not np.float64:
        sides = [(row, code, np.minimum(x, x.dtype.type(min(bound, np.iinfo(x.dtype).max)))) for row, code, x in sides]
    part = np.zeros((a.n, b.n), kind)
    for x, y in _dense(*sides, len(shared), a.n, b.n, kind):
        rows = max(16, AT_ONCE // b.n)
        least = np.empty((min(rows, a.n), b.n), kind)
        for at in range(0, a.n, rows):
            some = part[at:at + rows]
            for c in range(len(x)):
                np.minimum(x[c, at:at + rows, None], y[c], out=least[:len(some)])
                some += least[:len(some)]
    return part.astype(float)


def _squared_gaps(a: Block, b: Block, code: np.ndarray, variables: int) -> np.ndarray:
    part = np.zeros((a.n, b.n))
    for x, y in _dense((a.row, a.code, a.x), (b.row, code, b.x), variables, a.n, b.n, np.float64):
        rows = max(16, AT_ONCE // 4 // b.n)
        gap = np.empty((min(rows, a.n), b.n))
        for at in range(0, a.n, rows):
            some = part[at:at + rows]
            g = gap[:len(some)]
            for c in range(len(x)):
                np.subtract(x[c, at:at + rows, None], y[c], out=g)
                np.multiply(g, g, out=g)
                some += g
    return part


def _dense(one: tuple, other: tuple, variables: int, na: int, nb: int, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matrices of variables by samples, so many variables at a time that ``DENSE_BYTES`` hold them."""
    step = max(1, DENSE_BYTES // (np.dtype(kind).itemsize * (na + nb)))
    for at in range(0, variables, step):
        out = []
        for (row, code, x), n in ((one, na), (other, nb)):
            m = np.zeros((min(step, variables - at), n), kind)
            here = slice(None) if step >= variables else (code >= at) & (code < at + step)
            m[code[here] - at, row[here]] = x[here]
            out.append(m)
        yield out[0], out[1]


def _met_parts(one: tuple, other: tuple, na: int, nb: int) -> np.ndarray:
    """Sums of the smaller values, cell by cell, some rows at a time, so that what is added to stays near."""
    (ra, ca, xa), (rb, cb, xb) = ((r, c, x.astype(float)) for r, c, x in (one, other))
    part = np.zeros((na, nb))
    first, last = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    rows = max(1, AT_ONCE // nb)
    order = np.argsort(ra // rows, kind="stable")
    bounds = np.searchsorted(ra[order] // rows, np.arange(-(-na // rows) + 1))
    for k, (start, end) in enumerate(zip(bounds, bounds[1:])):
        low = k * rows
        some = order[start:end]
        met = (last - first)[some]
        ends = np.cumsum(met)
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
            n = met[at:to]
            i = np.repeat(some[at:to], n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
            wide = min(rows, na - low)
            part[low:low + wide] += np.bincount((ra[i] - low) * nb + rb[j], np.minimum(xa[i], xb[j]), wide * nb).reshape(wide, nb)
            at = to
    return part


def distances(a: Block, b: Block, metric: str) -> np.ndarray:
    """Distances of the rows of two whole blocks; NaN where Bray-Curtis has two empty samples."""
    part = tile_sums(a, b, metric)
    if metric != "bray":
        return np.sqrt(part, out=part)
    with np.errstate(invalid="ignore", divide="ignore"):
        part *= 2
        part /= a.total[:, None] + b.total
        return np.maximum(np.subtract(1, part, out=part), 0.0, out=part)


def unknown(a: Block, b: Block, metric: str) -> list[np.ndarray]:
    """Which pairs of rows have no Bray-Curtis dissimilarity, as both samples are empty; nothing where there are none."""
    if metric != "bray":
        return []
    if min(a.total.min(), b.total.min()) > 0:
        return []
    empty = a.total[:, None] + b.total == 0
    return [empty] if empty.any() else []


def tile_pairs(low: pa.Array, high: pa.Array, own: bool, values: Sequence[np.ndarray]) -> Iterator[list]:
    """The pairs of two blocks' ids, the smaller id first, with their ``values`` (matrices); of one block with itself each pair once."""
    plain = pa.types.is_integer(low.type) and not low.null_count + high.null_count
    if plain:
        one, other, ids = low.to_numpy(), high.to_numpy(), None
    else:
        ids = pa.concat_arrays([low, high])
        order = pc.sort_indices(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        one, other, ids = rank[:len(low)], rank[len(low):], ids.take(order)
    step = max(1, PAIRS_AT_ONCE // max(1, len(high)))
    for at in range(0, len(low), step):
        some = one[at:at + step, None]
        ends = [np.minimum(some, other), np.maximum(some, other)]
        found = [v[at:at + step] for v in values]
        if own:  # ids are in order within a block
            keep = np.arange(at, at + len(some))[:, None] < np.arange(len(high))
            ends, found = [e[keep] for e in ends], [v[keep] for v in found]
        ends = [pa.array(e.ravel()) for e in ends]
        yield [*(ends if plain else [ids.take(e) for e in ends]), *(v.ravel() for v in found)]


def block_count(samples: int, cells: int, chunks: int = 1, block_samples: int | None = None) -> int:
    """Blocks that samples are dealt into; distances do not depend on it."""
    if block_samples is None:
        block_samples = min(BLOCK_SAMPLES[1], max(BLOCK_SAMPLES[0], samples // 16))
    return max(1, -(-samples // block_samples), -(-cells // (chunks * BLOCK_CELLS)))


def _distance_tiles(df: DataFrame, sample: str, variable: str, value: str, metric: str,
                    block_samples: int | None, chunk_taxa: int) -> tuple[DataFrame, Cells]:
    """Every unordered sample pair with its distance, computed tile by tile, and the cells they come from.

    Samples are hashed into blocks and packed; a tile is two blocks. A sample with more than ``chunk_taxa`` values makes
    chunks of the taxa, whose sums add up. A tile's size does not depend on how many samples share a taxon, nor on how many taxa a sample has.
    """
    cells = Cells(df, sample, variable, value, metric)
    id_type, sizes = df.schema[sample].dataType, cells.sizes
    # The sizes only choose the number of blocks and chunks; the result does not depend on them.
    most = sizes.variables if sizes.variables * 1.25 < chunk_taxa else cells.largest(chunk_taxa)
    chunks = cells.chunks = max(1, -(-most // chunk_taxa))
    blocks = block_count(sizes.samples, sizes.cells, chunks, block_samples)
    table = cells.table.withColumn("_chunk", F.pmod(F.xxhash64("_variable"), F.lit(chunks)).cast("int"))
    if chunks > 1:
        # A sample without taxa in a chunk still forms pairs there; its distance part is then that of zeros.
        # A sample without any value forms none, however many chunks there are.
        every = table.select("_id").distinct().select("_id", F.lit(None).cast(table.schema["_variable"].dataType).alias("_variable"), F.lit(None).cast("double").alias("_x"),
                                                      F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))
        table = table.unionByName(every)
    table = table.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    made = stored(packed(table, ["_block", "_chunk"], id_type), "blocks")
    met = crossed(made, blocks * chunks, ["_block", "_chunk"],
                  (F.col("_chunk_a") == F.col("_chunk_b")) & (F.col("_block_a") <= F.col("_block_b")))
    schema = T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type),
                           *(T.StructField(c, T.DoubleType()) for c in (["d"] if chunks == 1 else ["_part", "_both"]))])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Blocks(["_block", "_chunk"])
        for batch in batches:
            for k in range(batch.num_rows):
                yield from tile({c: batch.column(c)[k] for c in batch.schema.names}, held)

    def tile(row: dict, held: Blocks) -> Iterator[pa.RecordBatch]:
        a, b = held.of(row, "a"), held.of(row, "b")
        own = row["_block_a"].as_py() == row["_block_b"].as_py()
        values = [distances(a, b, metric), *unknown(a, b, metric)] if chunks == 1 else [tile_sums(a, b, metric), a.total[:, None] + b.total]
        for ids_a, ids_b, *found in tile_pairs(row["ids_a"].values, row["ids_b"].values, own, values):
            made = [pa.array(found[0], mask=found[1] if found[1:] else None)] if chunks == 1 else map(pa.array, found)
            yield pa.record_batch([ids_a, ids_b, *made], names=schema.names)

    pairs = met.mapInArrow(tiles, schema)
    if chunks > 1:
        pairs = pairs.groupBy("id_a", "id_b").agg(F.sum("_part").alias("_part"), F.sum("_both").alias("_both"))
        if metric == "bray":
            d = F.greatest(1 - F.try_divide(2 * F.col("_part"), F.col("_both")), F.lit(0.0))
        else:
            d = F.sqrt("_part")
        pairs = pairs.select("id_a", "id_b", d.alias("d"))
    return pairs, cells


def bray_curtis(df: DataFrame, sample: str = "sample_id", variable: str = "taxon_id", value: str = "count",
                block_samples: int | None = None, chunk_taxa: int = CHUNK_TAXA) -> DataFrame:
    """Bray-Curtis dissimilarity of every sample pair, ``(id_a, id_b, d)`` with ``id_a < id_b``.

    ``sum|x-y| / sum(x+y)``, computed as ``1 - 2 sum(min(x,y)) / sum(x+y)``; two empty samples give NULL.
    """
    out, cells = _distance_tiles(df, sample, variable, value, "bray", block_samples, chunk_taxa)
    out.made_of = cells
    return out


def euclidean(df: DataFrame, sample: str = "sample_id", variable: str = "taxon_id", value: str = "count",
              block_samples: int | None = None, chunk_taxa: int = CHUNK_TAXA) -> DataFrame:
    """Euclidean distance of every sample pair over long-form variables; an absent cell is 0."""
    out, cells = _distance_tiles(df, sample, variable, value, "euclidean", block_samples, chunk_taxa)
    out.made_of = cells
    return out


def dist_pairs_join(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two distance sets side by side for the pairs present in both.

    Sets that know what they are made of are computed tile by tile beside each other, so that no pair is written. Others are sorted and
    merged: Spark guesses the pairs to be no more than the samples they come from, and a set sent to every task would pass the driver.
    """
    made = [getattr(df, "made_of", None) for df in (first, second)]
    if all(m is not None and m.chunks == 1 for m in made) and first.schema["id_a"].dataType == second.schema["id_a"].dataType:
        return _tiles_beside(*made, first.schema["id_a"].dataType)
    return first.select("id_a", "id_b", F.col("d").alias("d1")).hint("merge").join(
        second.select("id_a", "id_b", F.col("d").alias("d2")), ["id_a", "id_b"])


def _tiles_beside(first: Cells, second: Cells, id_type: T.DataType) -> DataFrame:
    """Both distances of every pair of samples that both sets of cells have, computed in one tile."""
    sides = (first, second)
    blocks = max(block_count(m.sizes.samples, m.sizes.cells) for m in sides)
    packs = [packed(m.table.where(F.col("_id").isNotNull()).withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")), ["_block"], id_type)
             for m in sides]
    columns = ("ids", *_PACKED)
    one, other = (df.withColumnsRenamed({c: f"{c}{k}" for c in columns}) for k, df in enumerate(packs, 1))
    made = stored(one.join(other, "_block"), "blocks")
    met = crossed(made, blocks, ["_block"], F.col("_block_a") <= F.col("_block_b"))
    schema = T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("d1", T.DoubleType()), T.StructField("d2", T.DoubleType())])
    metrics = [m.metric for m in sides]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Blocks(["_block"], k) for k in (1, 2)]
        for batch in batches:
            for k in range(batch.num_rows):
                yield from tile({c: batch.column(c)[k] for c in batch.schema.names}, held)

    def tile(row: dict, held: list[Blocks]) -> Iterator[pa.RecordBatch]:
        ids, at = [], []  # of both sides: the ids that both sets have, and where each set has them
        for e in "ab":
            mine, theirs = (row[f"ids{k}_{e}"].values for k in (1, 2))
            place = pc.index_in(mine, value_set=theirs)
            ids.append(mine.filter(place.is_valid()))
            at.append((np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False)), place.drop_null().to_numpy()))
        values, missing = [], []
        for k in (0, 1):
            a, b = (held[k].of(row, e) for e in "ab")
            here = np.ix_(at[0][k], at[1][k])
            values.append(distances(a, b, metrics[k])[here])
            none = unknown(a, b, metrics[k])
            missing.append(none[0][here] if none else np.zeros(values[k].shape, bool))
        own = row["_block_a"].as_py() == row["_block_b"].as_py()
        for ids_a, ids_b, *found in tile_pairs(*ids, own, [*values, *missing]):
            yield pa.record_batch([ids_a, ids_b, *(pa.array(found[k], mask=found[k + 2]) for k in (0, 1))], names=schema.names)

    return met.mapInArrow(tiles, schema)
