"""Repeated passages across documents, found with automata of repeated phrases.

A window is ``WINDOW`` consecutive words. Its anchor is the smallest hash among its runs of ``GRAM`` words, so equal windows
have equal anchors, and a document has about one anchor in thirteen words.

1. Exact copies are settled by a hash of their words: the smallest doc_id of a group stands for all.
2. Anchors that occur in several documents mark candidate windows; hashes of these windows that occur in several documents
   confirm recurring windows. The smallest document of a recurring window is its owner.
3. Each document's recurring windows are cut out as passages, per owner; the owner's have each different window once.
4. The owner's passages are compiled, in blocks of ``GRAM`` words, to Aho-Corasick automata. The owner is the shard: its row
   comes ahead of the rows of its followers in one partition, and an owner with very many followers stands ahead of each
   slice of them. Automata are built for as many owners as ``AUTOMATON`` holds, and the followers' passages stream through;
   each block found is extended to the longest run of words that the owner has too. Runs of ``WINDOW`` words or more are removed.

Every window of a document that a smaller document has too lies in a passage of its owner and holds one whole block of it,
so it is found; and what is removed was compared word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.words import run_hashes, split_words, word_numbers
from quadrat.session import spent, stored

WINDOW, GRAM = 50, 25

#: Characters of passages in one automaton.
AUTOMATON = 400_000

#: Followers of an owner in one slice.
SLICE = 2000

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_SPANS = "array<struct<start:int,stop:int>>"


def anchors(numbers: np.ndarray) -> np.ndarray:
    """Anchor of each window, in order."""
    grams = run_hashes(numbers, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return grams[:0]
    least, reach = grams, 1  # minima over doubling reaches
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    return np.minimum(least[:len(grams) - width + 1], least[width - reach:][:len(grams) - width + 1])


def text_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def text_key(hashed: str) -> int:
    """The first 64 bits of a text's hash: tells the texts of one doc_id apart."""
    return int.from_bytes(bytes.fromhex(hashed[:16]), "little", signed=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _marks(docs: DataFrame) -> DataFrame:
    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 500):
                some = df.iloc[at:at + 500]
                words = [split_words(t) for t in some["text"]]
                hashes = [text_hash(w) for w in words]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "n_words": [len(w) for w in words], "words_hash": hashes, "key": [text_key(h) for h in hashes],
                                    "anchors": [np.unique(anchors(word_numbers(w))).view(np.int64) if len(w) >= WINDOW else None for w in words]})

    return docs.select("doc_id", "text").mapInPandas(mark, "doc_id long, n_words long, words_hash string, key long, anchors array<long>")


def _candidate_windows(texts: DataFrame) -> DataFrame:
    """Windows with a recurring anchor, from rows of (doc_id, key, text, recurring); ``fresh`` where the text has the window for the first time."""
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 200):
                some, places, hashes, fresh = df.iloc[at:at + 200], [], [], []
                for text, key, recurring in zip(some["text"], some["key"], some["recurring"]):
                    words = split_words(text)
                    numbers = word_numbers(words if text_key(text_hash(words)) == key else [])  # ids that repeat with other words
                    hit = np.flatnonzero(np.isin(anchors(numbers), np.asarray(recurring, np.int64).view(np.uint64)))
                    own = run_hashes(numbers, WINDOW)[hit]
                    new = np.zeros(len(hit), bool)
                    new[np.unique(own, return_index=True)[1]] = True
                    places.append(hit.astype(np.int32))
                    hashes.append(own.view(np.int64))
                    fresh.append(new)
                yield some[["doc_id", "key"]].assign(places=places, hashes=hashes, fresh=fresh)

    return texts.mapInPandas(find, "doc_id long, key long, places array<int>, hashes array<long>, fresh array<boolean>")


def _passages(texts: DataFrame) -> DataFrame:
    """One row per document and owner with the passages of the document, from rows with ``owned`` (owner, places)."""
    columns = ["owner", "doc_id", "key", "starts", "passages"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for doc_id, key, text, owned in zip(df["doc_id"], df["key"], df["text"], df["owned"]):
                words = split_words(text)
                if text_key(text_hash(words)) != key:
                    continue
                words = [w.decode("utf-8", "surrogatepass") for w in words]
                for part in owned:
                    spans = merged([(p, p + WINDOW) for p in part["places"]])
                    rows.append((part["owner"], doc_id, key, [a for a, _ in spans], [" ".join(words[a:b]) for a, b in spans]))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return texts.mapInPandas(cut, "owner long, doc_id long, key long, starts array<int>, passages array<string>")


class PhraseAutomaton:
    """Aho-Corasick automaton over the ``GRAM``-word blocks of owners' passages. An owner is (doc_id, key)."""

    def __init__(self, owners: dict[tuple[int, int], list[str]]):
        self.automaton, self.words, places = ahocorasick.Automaton(), {}, defaultdict(list)
        for owner, passages in owners.items():
            for k, passage in enumerate(passages):
                words = self.words[owner, k] = passage.split(" ")
                for at in range(0, len(words) - GRAM + 1, GRAM):
                    places[f" {' '.join(words[at:at + GRAM])} "].append((owner, k, at))
        for phrase, where in places.items():
            self.automaton.add_word(phrase, (len(phrase), where))
        if places:
            self.automaton.make_automaton()

    def runs(self, text: str, owner: tuple[int, int]) -> list[tuple[int, int]]:
        """Word spans of ``WINDOW`` words or more in ``text`` that a passage of ``owner`` has too."""
        if not len(self.automaton):
            return []
        words, line = text.split(" "), f" {text} "
        starts = {c: i for i, c in enumerate(np.cumsum([0, *(len(w) + 1 for w in words)]).tolist())}
        found: list[tuple[int, int]] = []
        reached: dict[tuple[int, int], int] = {}  # by passage and shift: the end of the last run
        for end, (length, where) in self.automaton.iter(line):
            i = starts[end - length + 1]
            for who, k, at in where:
                if who != owner or reached.get((k, i - at), -1) >= i + GRAM:
                    continue
                other, a, b = self.words[who, k], 0, GRAM
                while i - a > 0 and at - a > 0 and words[i - a - 1] == other[at - a - 1]:
                    a += 1
                while i + b < len(words) and at + b < len(other) and words[i + b] == other[at + b]:
                    b += 1
                reached[k, i - at] = i + b
                if a + b >= WINDOW:
                    found.append((i - a, i + b))
        return found


def _located(passages: DataFrame) -> DataFrame:
    """Spans to remove, from rows of (owner, slice, own, doc_id, key, starts, passages): in a partition the rows of an owner and
    slice follow one another, the owner's own texts first."""
    columns = ["doc_id", "key", "spans"]

    def flush(owners: dict[tuple[int, int], list[str]], waiting: list) -> pd.DataFrame:
        automaton, rows = PhraseAutomaton(owners), []
        texts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for owner in owners:
            texts[owner[0]].append(owner)
        for owner, doc_id, key, starts, parts in waiting:
            found = merged([(start + a, start + b) for start, part in zip(starts, parts) for own in texts[owner] for a, b in automaton.runs(part, own)])
            rows.append((doc_id, key, [{"start": a, "stop": b} for a, b in found]))
        return pd.DataFrame(rows, columns=columns)

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owners: dict[tuple[int, int], list[str]] = {}
        waiting, size, read, last = [], 0, 0, None
        for df in frames:
            for owner, part, own, doc_id, key, starts, parts in zip(*(df[c] for c in ("owner", "slice", "own", "doc_id", "key", "starts", "passages"))):
                full = size > AUTOMATON and (owner, part) != last
                if full or (not own and read > AUTOMATON):
                    yield flush(owners, waiting)
                    waiting, read = [], 0
                    if full:
                        owners, size = {}, 0
                last = owner, part
                if own:
                    if (owner, key) not in owners:
                        owners[owner, key] = list(parts)
                        size += sum(map(len, parts))
                else:
                    waiting.append((owner, doc_id, key, starts, parts))
                    read += sum(map(len, parts))
        if waiting:
            yield flush(owners, waiting)

    return passages.mapInPandas(locate, f"doc_id long, key long, spans {_SPANS}")


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(marks, spans)``: per row doc_id, n_words, words_hash, key and ``copied`` (a smaller document has the same words); and
    per (doc_id, key) of the other documents the word spans that a smaller document has too, where there are any."""
    raw = stored(_marks(docs), "marks")
    least = raw.groupBy("words_hash").agg(F.min("doc_id").alias("least"))
    full = stored(raw.join(least, "words_hash").withColumn("copied", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least"), "originals")
    spent(raw)
    marked = stored(full.drop("anchors"), "texts")
    first = full.where("NOT copied AND anchors IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = first.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    recurring = first.join(shared, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("recurring"))
    texts = docs.select("doc_id", "text")

    windows = stored(_candidate_windows(recurring.join(texts.hint("merge"), "doc_id")), "windows")
    spent(full)
    rows = windows.select("doc_id", "key", F.explode(F.arrays_zip("places", "hashes", "fresh")).alias("w")).select("doc_id", "key", "w.places", "w.hashes", "w.fresh")
    owners = rows.where("fresh").groupBy("hashes").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owned = rows.join(owners, "hashes").where("fresh OR doc_id <> owner").groupBy("doc_id", "key", "owner").agg(F.sort_array(F.collect_set("places")).alias("places"))
    owned = owned.groupBy("doc_id", "key").agg(F.collect_list(F.struct("owner", "places")).alias("owned"))
    passages = stored(_passages(owned.join(texts.hint("merge"), "doc_id")), "passages")
    spent(windows)
    followed = passages.where("doc_id > owner")
    slices = followed.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    ahead = passages.where("doc_id = owner").join(slices, "owner").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    behind = followed.join(slices, "owner").withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.col("slices")).cast("int"))
    both = ahead.withColumn("own", F.lit(True)).unionByName(behind.withColumn("own", F.lit(False))).drop("slices")
    both = both.repartition("owner", "slice").sortWithinPartitions("owner", "slice", F.desc("own"), "doc_id", "key")
    spans = _located(both).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans")).where(F.size("spans") > 0)
    return marked, spans


def _outside(n: int, spans) -> np.ndarray:
    keep = np.ones(n, bool)
    for span in spans:
        keep[span["start"]:span["stop"]] = False
    return keep


def removal_digest(docs: DataFrame) -> DataFrame:
    """Per document n_words, n_removed and the SHA-256 of the kept words joined by one space.

    NULL, empty and word-free texts have no words; a document of fewer than ``WINDOW`` words loses none, nor does one
    without a doc_id, which stands in no order. Rows with one doc_id do not take words from each other.
    """
    marked, spans = repeated_spans(docs)

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for doc_id, key, text, cut in zip(df["doc_id"], df["key"], df["text"], df["spans"]):
                words = split_words(text)
                if text_key(text_hash(words)) == key:
                    keep = _outside(len(words), cut)
                    rows.append((doc_id, key, int((~keep).sum()), text_hash([w for w, k in zip(words, keep) if k])))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "_removed", "_hash"])

    changed = spans.join(docs.select("doc_id", "text").hint("merge"), "doc_id").mapInPandas(digest, "doc_id long, key long, _removed long, _hash string")
    rows = marked.join(changed.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"], "left")
    whole = F.col("copied") & (F.col("n_words") >= WINDOW)
    return rows.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(whole, F.lit(text_hash([]))).otherwise(F.coalesce("_hash", "words_hash")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``; other words keep their white space. Every row stays; ``n_chars``
    follows the text."""
    columns = docs.columns
    marked, spans = repeated_spans(docs)
    whole = marked.where(F.col("copied") & (F.col("n_words") >= WINDOW)).select("doc_id", "key", F.array(
        F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))).alias("spans")).distinct()
    cuts = spans.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("_cuts"))

    @F.pandas_udf("string")
    def cut_text(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, cuts):
            if found is not None:
                words = split_words(text)
                own = text_key(text_hash(words))
                spans = [s for c in found if c["key"] == own for s in c["spans"]]
                if spans:
                    data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
                    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
                    for a, b in merged([(s["start"], s["stop"]) for s in spans]):
                        kept.append(data[at:starts[a]])
                        at = starts[b]
                    text = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    rows = docs.select("doc_id", F.struct(*columns).alias("_row")).join(cuts.hint("merge"), "doc_id", "left")
    changed = F.col("_cuts").isNotNull()
    rows = rows.withColumn("_text", cut_text(F.when(changed, F.col("_row.text")), "_cuts"))
    new = {"text": F.when(changed, F.col("_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))
    return rows.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in columns))
