"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full shingle sets, grouping.

1. One pass over the texts gives each document its number of shingles, a fingerprint of its shingle set, and band hashes
   of its SuperMinHash signature.
2. Documents with equal sets are one node, the smallest id of them.
3. Nodes that share a band are linked to the band's smallest node; the components of these links are the candidate
   clusters. No pairs are formed here.
4. Inside a cluster, nodes are dealt to blocks of bounded size. A block counts the common shingles of all its pairs at once
   and returns a spanning forest of the links that hold on the full sets, not the links. Clusters of several blocks then
   compare each node outside their largest group with the whole cluster, block against block.
5. Components over the forests give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.components import components
from quadrat.llm.words import mixed, run_hashes, split_words, word_numbers
from quadrat.session import stored

#: Bands and rows of the signature: at similarity 0.8 a pair shares no band in 5 of a million cases, at 0.85 in 6 of a billion.
BANDS, ROWS = 40, 6

#: Nodes of a block, and shingle columns that are counted at once.
BLOCK, COLUMNS = 192, 4096

#: Elements that go through the signature loop at once.
CHUNK = 24_000


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` lower-cased words; fewer words are one run; no words, none."""
    numbers = word_numbers(split_words(text, lower=True))
    if 0 < len(numbers) < width:
        return run_hashes(numbers, len(numbers)) ^ np.uint64(len(numbers))
    return np.unique(run_hashes(numbers, width))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures: element x gives slot p_x(j) the value j + u_x(j), p_x being its random permutation.

    The permutations are drawn by their steps j = 0, 1, ..., one step of all elements at a time. Values of step j are below
    those of later steps, so a set is finished once all its slots are filled: after few steps for all but tiny sets.
    Slots of empty sets stay infinite.
    """
    out = np.full((len(sets), slots), np.inf)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        _fill(out[at:end], sets[at:end], slots)
        at = end
    return out


def _fill(out: np.ndarray, sets: list[np.ndarray], slots: int) -> None:
    element = np.concatenate([*sets, np.empty(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order, flat = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1)), out.ravel()
    row = np.arange(len(element))
    for j in range(slots):
        if not len(element):
            break
        draw = mixed(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        value = j + (draw >> np.uint64(32)).astype(np.float64) / 2**32
        other = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        slot = order[row, other].astype(np.int64)
        order[row, other] = order[row, j]
        np.minimum.at(flat, owner * slots + slot, value)
        open_ = np.isinf(out).any(axis=1)[owner]
        if not open_.all():
            element, owner, order = element[open_], owner[open_], order[open_]
            row = np.arange(len(element))


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = np.ascontiguousarray(signatures[:, :bands * rows]).view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        out = mixed(out + parts[:, :, k])
    return out.view(np.int64)


def marks(docs: DataFrame, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, fingerprint of the set and band hashes (NULL for empty sets)."""
    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 256):
                some = df.iloc[at:at + 256]
                sets = [shingles(t, width) for t in some["text"]]
                hashes = band_hashes(super_minhash(sets, bands * rows), bands, rows)
                yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets],
                                    "fingerprint": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
                                    "bands": [h if len(s) else None for s, h in zip(sets, hashes)]})

    known = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return known.mapInPandas(mark, "doc_id long, n_shingles long, fingerprint string, bands array<long>")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    hashes = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, times = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    column, owner = rank[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    last = column[-1] + 1 if len(column) else 0
    for start in range(0, last, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(left) + len(right), min(COLUMNS, last - start)), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        out += dense[:len(left)] @ dense[len(left):].T
    return out.astype(np.int64)


def forest(left_ids, left: list[np.ndarray], right_ids, right: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides."""
    common = common_counts(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, k in zip(*np.nonzero(100 * common >= percent * sizes)):
        a, b = int(left_ids[i]), int(right_ids[k])
        if (ra := root(a)) != (rb := root(b)):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def candidate_clusters(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, bands) that share a band with others: (doc_id, cluster), directly or over further nodes."""
    rows = nodes.select("doc_id", F.posexplode("bands").alias("band", "hash"))
    least = rows.groupBy("band", "hash").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").drop("last")
    stars = rows.join(least, ["band", "hash"]).where("doc_id > hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    found = components(stars)
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("cluster")).unionByName(
        found.select(F.col("b").alias("doc_id"), F.col("b").alias("cluster")).distinct())


def verified_links(docs: DataFrame, clusters: DataFrame, percent: int, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Forests (a, b) over all links of at least ``percent`` within the clusters, on full shingle sets."""
    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 256):
                some = df.iloc[at:at + 256]
                yield some.drop(columns="text").assign(shingles=[shingles(t, width).tobytes() for t in some["text"]])

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    dealt = clusters.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    sets = stored(docs.select("doc_id", "text").join(dealt.hint("merge"), "doc_id").mapInPandas(load, "doc_id long, cluster long, blocks int, block int, shingles binary"), "sets")

    def inside(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates(["doc_id", "shingles"])
        own = _sets(df["shingles"])
        return pd.DataFrame(forest(df["doc_id"].to_numpy(), own, df["doc_id"].to_numpy(), own, percent), columns=["a", "b"])

    first = stored(sets.groupBy("cluster", "block").applyInPandas(inside, "a long, b long"), "forests")
    wide = sets.where("blocks > 1")
    if wide.isEmpty():
        return first
    return _across_blocks(wide, first, percent, block)


def _across_blocks(wide: DataFrame, first: DataFrame, percent: int, block: int) -> DataFrame:
    """The groups so far, and links of nodes outside their cluster's largest group to all nodes of the cluster."""
    stars = components(first)
    groups = stars.select(F.col("a").alias("doc_id"), F.col("b").alias("_group"))
    labelled = stored(wide.select("doc_id", "cluster").distinct().join(groups, "doc_id", "left")
                      .withColumn("group", F.coalesce("_group", "doc_id")).drop("_group"), "labels")
    counts = labelled.groupBy("cluster", "group").agg(F.count("*").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max_by("group", F.struct("n", -F.col("group"))).alias("main"))
    stray = labelled.join(largest, "cluster").where("group != main").select("cluster", "doc_id")
    number = stray.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("strays"))
    every = wide.join(number, "cluster")
    copies = every.select("cluster", "block", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("other"), F.lit(0).alias("side"), "doc_id", "shingles")
    some = every.join(stray.select("doc_id", "cluster"), ["doc_id", "cluster"], "left_semi")
    some = some.withColumn("other", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.col("strays")).cast("int"))
    some = some.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "other", F.lit(1).alias("side"), "doc_id", "shingles")

    def across(df: pd.DataFrame) -> pd.DataFrame:
        a, b = (df[df["side"] == k].drop_duplicates(["doc_id", "shingles"]) for k in (0, 1))
        links = forest(a["doc_id"].to_numpy(), _sets(a["shingles"]), b["doc_id"].to_numpy(), _sets(b["shingles"]), percent) if len(a) and len(b) else []
        return pd.DataFrame(links, columns=["a", "b"])

    return stars.unionByName(copies.unionByName(some).groupBy("cluster", "block", "other").applyInPandas(across, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id reachable over links), kept (it is that document).

    Documents are linked if 100 * common >= ``percent`` * union of their shingle sets. NULL, empty and word-free texts have
    no shingles and no links. Rows that repeat a doc_id are one node, linked by the id; each is returned, with its own
    n_shingles. Rows without a doc_id can be no node: they get NULL as component and are kept.
    """
    marked = stored(marks(docs, width, bands, rows), "marks")
    equal = marked.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node"))
    nodes = marked.where("fingerprint IS NOT NULL").join(equal, "fingerprint").select("doc_id", "node", "bands")
    clusters = stored(candidate_clusters(nodes.where("doc_id = node").select("doc_id", "bands")), "clusters")
    links = verified_links(docs, clusters, percent, width, block)
    same = nodes.where("doc_id > node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(same)).select(F.col("a").alias("doc_id"), F.col("b").alias("_least"))
    component = F.coalesce("_least", "doc_id")
    out = marked.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    none = docs.where(F.col("doc_id").isNull()).select("doc_id", "text").mapInPandas(
        lambda frames: (pd.DataFrame({"n_shingles": [len(shingles(t, width)) for t in df["text"]]}) for df in frames), "n_shingles long")
    return out.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
