"""Documents as token ids in binary shards, compressed one by one with a shared dictionary.

A store is a folder with

* ``dictionary``: the zstandard dictionary, trained on id arrays of a bounded sample of documents;
* ``shards/*.ids``: one file per task, documents in ascending ``doc_id`` order (NULL first):
  magic ``QIDS1``, one byte with the bytes per id, the dictionary's 8-byte hash, one zstandard frame per document, then an
  index of (doc_id, is NULL, frame offset, frame bytes, number of ids) per document, and the index's offset and rows;
* ``manifest``: Parquet with one row per committed shard. A task that runs again writes another file name, and only
  the files of tasks that Spark commits are in the manifest.

A document is read with its index row and one frame; nothing else of its shard is decompressed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.llm.encoding import encoder

MAGIC = b"QIDS1"
HEAD, TAIL = "<5sBQ", "<QQ"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "<u1"), ("offset", "<u8"), ("bytes", "<u8"), ("n_tokens", "<u8")])

#: Documents whose ids train the dictionary, and the most bytes it may have.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 64 * 1024


def _open(folder: str):
    """File system and path of a folder on any store that pyarrow can reach."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:/") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def _width(vocabulary: str) -> int:
    return 2 if encoder(vocabulary, False).size <= 1 << 16 else 4


def _ids(texts: list[str | None], vocabulary: str, keeps_space: bool, end_id: int) -> list[np.ndarray]:
    return [np.append(ids, np.uint32(end_id)) for ids in encoder(vocabulary, keeps_space).encode([t or "" for t in texts])]


def train_dictionary(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary from the ids of the ``sample_docs`` documents whose doc_id hashes lowest; empty if they are too few."""
    width = f"<u{_width(vocabulary)}"
    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def serialize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield pd.DataFrame({"ids": [i.astype(width).tobytes() for i in _ids(df["text"].tolist(), vocabulary, keeps_space, end_id)]})

    samples = [bytes(r.ids) for r in sample.mapInPandas(serialize, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_store(docs: DataFrame, folder: str, vocabulary: str, keeps_space: bool = False, end_id: int = 1,
                sample_docs: int = SAMPLE_DOCS) -> None:
    """Write the ids of every whole text (NULL: empty) and ``end_id`` after each, in ascending doc_id order."""
    spark, folder = docs.sparkSession, _uri(folder)
    dictionary = train_dictionary(docs, vocabulary, keeps_space, end_id, sample_docs)
    files, root = _open(folder)
    files.create_dir(f"{root}/shards", recursive=True)
    with files.open_output_stream(f"{root}/dictionary") as out:
        out.write(dictionary)
    width, digest = _width(vocabulary), xxhash.xxh64_intdigest(dictionary)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _open(folder)
        compressor = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        name, index, at, out, first = f"{uuid.uuid4().hex}.ids", [], struct.calcsize(HEAD), None, None
        for df in frames:
            if out is None:
                out = files.open_output_stream(f"{root}/shards/{name}")
                out.write(struct.pack(HEAD, MAGIC, width, digest))
                first = df["doc_id"].iloc[0]
            for doc_id, ids in zip(df["doc_id"], _ids(df["text"].tolist(), vocabulary, keeps_space, end_id)):
                frame = compressor.compress(ids.astype(f"<u{width}").tobytes())
                out.write(frame)
                index.append((0 if pd.isna(doc_id) else doc_id, pd.isna(doc_id), at, len(frame), len(ids)))
                at += len(frame)
        if out is not None:
            table = np.array(index, INDEX)
            out.write(table.tobytes())
            out.write(struct.pack(TAIL, at, len(table)))
            out.close()
            yield pd.DataFrame({"shard": [name], "first_doc": pd.array([None if pd.isna(first) else int(first)], "Int64"),
                                "n_docs": [len(table)], "n_tokens": [int(table["n_tokens"].sum())]})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(write, "shard string, first_doc long, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")


class Shard:
    """One shard, open for reading."""

    def __init__(self, folder: str, name: str):
        files, root = _open(folder)
        with files.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        self.file = files.open_input_file(f"{root}/shards/{name}")
        size = self.file.size()
        magic, self.width, digest = struct.unpack(HEAD, self._read(0, struct.calcsize(HEAD)))
        if magic != MAGIC or digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError(f"{name}: another format or another dictionary")
        at, rows = struct.unpack(TAIL, self._read(size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
        self.index = np.frombuffer(self._read(at, rows * INDEX.itemsize), INDEX)
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in a row of the index."""
        entry = self.index[row]
        data = self.decompressor.decompress(self._read(int(entry["offset"]), int(entry["bytes"])))
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this doc_id (several if it repeats), by their index rows alone."""
    folder = _uri(folder)
    manifest = spark.read.parquet(f"{folder}/manifest").withColumn("next", F.lead("first_doc").over(Window.orderBy(F.asc_nulls_first("first_doc"))))
    near = manifest.where((F.coalesce("first_doc", F.lit(doc_id)) <= doc_id) & (F.coalesce("next", F.lit(doc_id)) >= doc_id))
    found = []
    for row in near.orderBy(F.asc_nulls_first("first_doc")).collect():  # one shard, or the few that a repeated id spans
        shard = Shard(folder, row.shard)
        found += [shard.ids(int(k)) for k in np.flatnonzero((shard.index["doc_id"] == doc_id) & (shard.index["null"] == 0))]
    return found


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the files hold it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, frame_bytes.

    Shards follow one another by first doc_id; their starts are prefix sums over the manifest, one row per shard.
    """
    folder = _uri(folder)
    manifest = spark.read.parquet(f"{folder}/manifest")
    order = Window.orderBy(F.asc_nulls_first("first_doc"), "n_docs", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).select("shard", "base")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for name, base in zip(df["shard"], df["base"]):
                shard = Shard(folder, name)
                n = shard.index["n_tokens"].astype(np.int64)
                doc = pd.array(shard.index["doc_id"], "Int64")
                doc[shard.index["null"] == 1] = pd.NA
                crc = [zlib.crc32(shard.ids(k)) for k in range(len(n))]
                yield pd.DataFrame({"doc_id": doc, "start": base + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crc, np.int64),
                                    "frame_bytes": shard.index["bytes"].astype(np.int64)})

    shards = max(1, manifest.count())
    return placed.repartition(shards).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long")
