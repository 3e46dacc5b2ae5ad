"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the prefix array holds S_i = sum of c_j * B^j for j < i, modulo a prime. A span's hash is the difference
of two entries, brought to one common power, so spans of equal text are equal wherever they stand; two prefix arrays
answer any span equality at once and find longest common extensions by binary search.

A fingerprint is the number of code points, the hash of the whole text, and a sketch: the spans of ``SPAN`` code points are dealt
to ``SLOTS`` slots by their hash and each slot keeps 16 bits of its smallest one. Slots without a span borrow from the next.
The likeness of two fingerprints is the share of slots that agree, an estimate of the share of common spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.keep import kept
from quadrat.llm.words import mixed

#: Two primes below 2^31 and a base for each: products stay below 2^62.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)

SPAN, SLOTS = 12, 64

def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base ``k`` and of its inverse, at least ``n`` of each, kept from call to call."""
    tables = kept("fingerprints powers", dict)
    have = tables.get(k)
    if have is None or len(have[0]) < n:
        size, p, out = max(4096, 1 << (n - 1).bit_length()), PRIMES[k], []
        for base in (BASES[k], pow(BASES[k], -1, p)):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done:2 * done] = table[:min(done, size - done)] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done *= 2
            out.append(table)
        have = tables[k] = (out[0], out[1])
    return have


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix hashes of a text's code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            up, _ = _powers(k, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:self.n] % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def spans(self, start: np.ndarray | int, stop: np.ndarray | int) -> np.ndarray:
        """Hash of each span; equal for equal text."""
        out = np.uint64(0)
        for k, p in enumerate(PRIMES):
            _, down = _powers(k, self.n + 1)
            part = (self.sums[k][stop] + np.uint64(p) - self.sums[k][start]) * down[start] % np.uint64(p)
            out = out << np.uint64(31) | part
        return np.asarray(out, np.uint64)

    def runs(self, width: int) -> np.ndarray:
        out = np.zeros(self.n - width + 1, np.uint64)
        for k, p in enumerate(PRIMES):
            _, down = _powers(k, self.n + 1)
            out = out << np.uint64(31) | (self.sums[k][width:] + np.uint64(p) - self.sums[k][:-width]) * down[:len(out)] % np.uint64(p)
        return out


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common text from place i of one and place j of the other, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if a.spans(i, i + middle) == b.spans(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def fingerprint(points: np.ndarray) -> str:
    """``length.whole.sketch`` in hexadecimal; the sketch of an empty text is empty."""
    n = len(points)
    prefixes = Prefixes(points)
    whole = int(prefixes.spans(0, n))
    if n == 0:
        return f"{n:x}.{whole:016x}."
    hashes = mixed(prefixes.runs(min(SPAN, n)))
    slot = (hashes >> np.uint64(58)).astype(np.int64)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, hashes << np.uint64(6))
    filled = np.unique(slot)
    lender = filled[np.searchsorted(filled, np.arange(SLOTS)) % len(filled)]
    values = mixed(least[lender] + lender.astype(np.uint64))  # a borrowed value says who lent it
    return f"{n:x}.{whole:016x}." + (values >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for fingerprints of equal texts, else the share of slots that agree; 0 if one text alone is empty."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u2") for f in (a, b))
    return float((x == y).mean()) if len(x) and len(y) else 0.0


def with_successors(docs: DataFrame, rows_each: int = 4000, most_parts: int = 4096) -> DataFrame:
    """Rows (part, key, doc_id, text, ahead): documents in parts of consecutive ids, each part with the first documents after it.

    Parts are cut at approximate quantiles of the ids, at most ``most_parts`` numbers, and are read in order as streams, so
    their size is no bound on memory. Only the first id of every part is sent twice. A NULL id is before all others. The
    last part is followed by the first of all.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", "text")
    parts = min(most_parts, max(1, -(-docs.count() // rows_each)))
    shares = [(k + 1) / parts for k in range(parts - 1)]
    cuts = keyed.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] if shares else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), "left").astype(np.int32))

    keyed = keyed.withColumn("part", place("key"))
    firsts = sorted((r.part, r.key) for r in keyed.groupBy("part").agg(F.min("key").alias("key")).collect())
    ahead = docs.sparkSession.createDataFrame([(key, firsts[k - 1][0]) for k, (_, key) in enumerate(firsts)], "key long, before int")
    extra = keyed.join(F.broadcast(ahead), "key").select(F.col("before").alias("part"), "key", "doc_id", "text", F.lit(True).alias("ahead"))
    return keyed.select("part", "key", "doc_id", "text", F.lit(False).alias("ahead")).unionByName(extra)


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Per document n_chars, fingerprint, and the edited text's hash, fingerprint and likeness, and the next document's.

    The edited text has the last quarter of its code points replaced by the first as many of the next document in ascending
    doc_id order, or all of them if it has fewer. NULL is the empty text; one row alone is its own next; rows that repeat
    an id follow each other by text.
    """
    parts = with_successors(docs)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before, waiting for its next
        for df in frames:
            rows = []
            for part, doc_id, text, ahead in zip(df["part"], df["doc_id"], df["text"], df["ahead"]):
                if held is None and ahead:
                    continue
                points = code_points(text)
                print_ = fingerprint(points)
                if held is not None and held[0] == part:
                    own, mark = held[2], held[3]
                    quarter = len(own) // 4
                    edited = np.concatenate([own[:len(own) - quarter], points[:quarter]])
                    digest_ = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    edited_print = mark if len(edited) == len(own) and (edited == own).all() else fingerprint(edited)
                    rows.append((held[1], len(own), digest_, mark, edited_print, likeness(mark, edited_print), likeness(mark, print_)))
                held = None if ahead else (part, doc_id, points, print_)
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    ordered = parts.repartition("part").sortWithinPartitions("part", "ahead", "key", "text")
    return ordered.select("part", "doc_id", "text", "ahead").mapInPandas(
        digest, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
