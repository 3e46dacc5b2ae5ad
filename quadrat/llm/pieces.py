"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for.

A text is normalised through the model's compiled character map: at every place the longest key of the map's double-array
trie is replaced, other code points stay. Every normalised byte keeps its source offset. Pair merging by piece score then
runs on the normalised text, and pieces are projected back to byte spans ``[begin, end)`` of the original.

Merges never reach over a place where no piece of the vocabulary holds both neighbours, so the normalised text is cut there,
and each different chunk is merged once, many chunks at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from quadrat.llm.keep import kept

MARK = "▁"

#: Characters and tokens of the chunks that one Python worker remembers; beyond, it starts anew after the batch.
REMEMBER = 16_000_000

#: Chunks of at most so many characters are merged many at once.
SHORT = 24
NEVER = 1 << 30

#: Characters of the texts that are encoded together.
AT_ONCE = 1_000_000

NORMAL, BYTE = 1, 6  # kinds of pieces in a model file


class CharacterMap:
    """The compiled character map of a model: a double-array trie from byte strings to replacements. Empty: identity."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at ``at``."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 1 << 9) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.strings[start:self.strings.index(b"\0", start)], length


def _chunk_pattern(vocabulary: dict[str, int]) -> str:
    """Matches stretches of a normalised text between which no merge can happen.

    Two neighbours can only merge if some piece holds them side by side. Characters that do so, directly or over others,
    form classes; a run of space marks goes with the run of one class after it.
    """
    leader: dict[str, str] = {}

    def find(c: str) -> str:
        while leader.setdefault(c, c) != c:
            leader[c] = leader[leader[c]]
            c = leader[c]
        return c

    for piece in vocabulary:
        inner = piece.lstrip(MARK)
        if MARK in inner:
            return ".+"
        for x, y in zip(inner, inner[1:]):
            leader[find(x)] = find(y)
    classes: dict[str, list[str]] = {}
    for c in leader:
        classes.setdefault(find(c), []).append(c)
    runs = "|".join(f"[{''.join(map(re.escape, c))}]+" for c in sorted(classes.values(), key=len, reverse=True))
    return f"{MARK}*(?:{runs + '|' if runs else ''}[^{MARK}])|{MARK}+"


class Column:
    """Numbers that grow at the end."""

    def __init__(self):
        self.room, self.n = np.empty(1024, np.int32), 0

    def extend(self, values) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[:self.n], np.empty(self.n + 2 * len(values), np.int32)])
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)


class Pieces:
    """A byte-fallback pair-merging model; other kinds of models and models with user-defined symbols are refused."""

    def __init__(self, model_file: str):
        self.processor = SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.processor.serialized_model_proto())
        trained = proto.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("the model must merge pairs, fall back to bytes and mark spaces in front")
        if {p.type for p in proto.pieces} & {4, 5}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.rules = proto.normalizer_spec
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [-1] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.end_id = self.processor.eos_id()
        self.chunks = re.compile(_chunk_pattern(self.ids), re.S)
        self._index()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, dict[str, int]] = {1: {}, 3: {}}  # by the bytes that a space mark counts
        self.flat, self.begins, self.ends, self.starts, self.lengths = (Column() for _ in range(5))
        self.starts.extend([0])
        self.weight = 0

    def normalized(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalised text, and the source offset of each of its bytes and of its end; None where only spaces were marked."""
        rules = self.rules
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not rules.remove_extra_whitespaces and rules.escape_whitespaces and rules.add_dummy_prefix and MARK not in text:
            return MARK + text.replace(" ", MARK), None
        data, space = text.encode(), MARK.encode() if rules.escape_whitespaces else b" "
        out, source, at = bytearray(), [], 0
        steps = []  # (replacement, start, end)
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at:at + width], width
            steps.append((found[0], at, at + found[1]))
            at += found[1]
        trim = rules.remove_extra_whitespaces
        first = next((k for k, s in enumerate(steps) if s[0] != b" "), len(steps)) if trim else 0
        begin = steps[first][1] if first < len(steps) else len(data)
        if begin == len(data):
            return "", np.zeros(1, np.int64)
        if rules.add_dummy_prefix:
            out += space
            source += [begin] * len(space)
        after_space, end = trim, len(data)
        for new, a, b in steps[first:]:
            if trim and after_space:
                new = new.lstrip(b" ")
            if new:
                placed = new.replace(b" ", space)
                out += placed
                source += [a] * len(placed)
                after_space = trim and new.endswith(b" ")
            end = b
        while trim and out.endswith(space) and len(out) >= len(space):
            end = source[-len(space)]
            del out[-len(space):], source[-len(space):]
        return out.decode(), np.array(source + [end], np.int64)

    def merged(self, chunk: str) -> list[str]:
        """The chunk after all merges: best score first, then leftmost."""
        parts: list[str | None] = list(chunk)
        n, scores = len(parts), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                both = parts[a] + parts[b]
                if both in scores:
                    heapq.heappush(heap, (-scores[both], a, b, both))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or len(parts[a]) + len(parts[b]) != len(both):
                continue
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _index(self) -> None:
        """Symbols by number, and for every pair of symbols that makes a piece the symbol of that piece."""
        names = sorted({c for p in self.ids for c in p} | set(self.ids))
        number = {name: i for i, name in enumerate(names)}
        order = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p])
        place, last = {}, None
        for p in order:  # equal scores share a place
            last = place[p] = last if last is not None and self.scores[p] == score else len(place)
            score = self.scores[p]
        pairs = sorted((number[p[:k]] << 32 | number[p[k:]], number[p], place[p]) for p in order for k in range(1, len(p))
                       if p[:k] in number and p[k:] in number)
        self.pair_keys, self.pair_symbols, self.pair_places = (np.array(x, np.int64) for x in zip(*pairs))
        self.symbol_ids = np.array([self.ids.get(name, -1) for name in names])
        self.symbol_bytes = np.array([len(name.encode()) for name in names])
        self.symbol_marks = np.array([name.count(MARK) for name in names])
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in (name for name in names if len(name) == 1):
            if c in self.ids:
                self.of_char[ord(c)] = number[c]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the piece that two symbols make (NEVER if none; symbol -1 is none), and its symbol."""
        keys = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        sound = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(sound, self.pair_places[at], NEVER), self.pair_symbols[at]

    def _merge_many(self, symbols: np.ndarray) -> np.ndarray:
        """All merges of many short chunks at once; a row holds a chunk's symbols, then -1."""
        out, rows = symbols.copy(), np.arange(len(symbols))
        now = symbols.copy()
        places, made = self._pairs(now[:, :-1], now[:, 1:])
        columns = np.arange(now.shape[1])
        while len(rows):
            best = places.argmin(1)  # the first of equal ones is the leftmost
            k = np.arange(len(rows))
            more = places[k, best] < NEVER
            out[rows[~more]] = now[~more]
            rows, now, places, made, best = rows[more], now[more], places[more], made[more], best[more]
            k = k[:len(rows)]
            new = made[k, best]
            shift = np.minimum(columns + (columns > best[:, None]), now.shape[1] - 1)
            now = np.take_along_axis(now, shift, 1)
            now[:, -1] = -1
            now[k, best] = new
            places, made = (np.take_along_axis(x, np.minimum(shift[:, :-1], x.shape[1] - 1), 1) for x in (places, made))
            places[:, -1] = NEVER
            for at in (best - 1, best):  # the pairs with the new symbol
                some = (at >= 0) & (at < places.shape[1])
                found = self._pairs(now[k[some], at[some]], now[k[some], at[some] + 1])
                places[k[some], at[some]], made[k[some], at[some]] = found
        return out

    def _learn_odd(self, chunk: str, mark: int) -> None:
        """Ids of one chunk with their byte spans in it, also where code points have no piece."""
        ids, begins, ends, at = [], [], [], 0
        for piece in self.merged(chunk):
            data = piece.encode()
            width = len(data) + piece.count(MARK) * (mark - 3)
            if piece in self.ids:
                ids.append(self.ids[piece])
                begins.append(at)
                ends.append(at + width)
            else:  # bytes of a code point without a piece: the last one stands for all of it
                ids += [self.bytes[b] for b in data]
                begins += [at] * len(data)
                ends += [at] * (len(data) - 1) + [at + width]
            at += width
        self._add(ids, begins, ends, [at], [len(ids)])

    def _add(self, ids, begins, ends, lengths, counts) -> None:
        base = self.flat.n
        for column, values in ((self.flat, ids), (self.begins, begins), (self.ends, ends), (self.lengths, lengths)):
            column.extend(values)
        self.starts.extend(base + np.cumsum(counts))
        self.weight += int(np.sum(lengths)) + 3 * len(ids) + 10 * len(lengths)

    def _learn(self, chunks: list[str], mark: int) -> None:
        """Enter new chunks; ``mark`` is the number of bytes that a space mark counts."""
        known = self.known[mark]
        short = [c for c in chunks if len(c) <= SHORT]
        lengths = np.array([len(c) for c in short], np.int64)
        symbols = np.full((len(short), SHORT + 1), -1, np.int32)
        filled = np.arange(SHORT + 1) < lengths[:, None]
        symbols[filled] = self.of_char[np.frombuffer("".join(short).encode("utf-32-le"), "<u4")]
        sound = (symbols >= 0).sum(1) == lengths if short else np.empty(0, bool)
        done = self._merge_many(symbols[sound])
        held = done >= 0
        counts, flat = held.sum(1), done[held]
        widths = self.symbol_bytes[flat] + self.symbol_marks[flat] * (mark - 3)
        ends = np.cumsum(widths)
        total = np.concatenate([[0], ends])[np.cumsum(counts)]
        before = np.concatenate([[0], total])[:-1]
        ends = ends - np.repeat(before, counts)
        for place, k in enumerate(np.flatnonzero(sound), self.lengths.n):
            known[short[k]] = place
        self._add(self.symbol_ids[flat], ends - widths, ends, total - before, counts)
        for chunk in [*(short[k] for k in np.flatnonzero(~sound)), *(c for c in chunks if len(c) > SHORT)]:
            known[chunk] = self.lengths.n
            self._learn_odd(chunk, mark)

    def _spread(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and spans of chunks in a row; spans count from the first chunk's start."""
        starts = self.starts.room[places]
        n = self.starts.room[places + 1] - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lengths = self.lengths.room[places]
        base = np.repeat(np.cumsum(lengths) - lengths, n)
        return self.flat.room[at], base + self.begins.room[at], base + self.ends.room[at]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids without the end id, and the begin and end of each id's bytes in the text."""
        norms = [self.normalized(t) for t in texts]
        # with no alignment every mark is one source byte; else spans are first taken in normalised bytes
        cut = [(self.chunks.findall(norm), 1 if source is None else 3) for norm, source in norms]
        for mark, known in self.known.items():
            new = {c for chunks, m in cut if m == mark for c in chunks if c not in known}
            if new:
                self._learn(sorted(new), mark)
        out = []
        for (chunks, mark), (_, source) in zip(cut, norms):
            ids, begin, end = self._spread(np.fromiter(map(self.known[mark].__getitem__, chunks), np.int64, len(chunks)))
            if source is None:  # the mark put in front has no source
                begin, end = np.maximum(begin - 1, 0), np.maximum(end - 1, 0)
            else:
                begin, end = source[begin], source[end]
            out.append((ids, begin, end))
        if self.weight > REMEMBER:
            self.forget()
        return out


def pieces(model: str) -> Pieces:
    """The model of this Python worker, kept from task to task; ``model`` names a public tokenizer file or is a path."""
    return kept(f"pieces {model}", lambda: Pieces(model if "/" in model else public_tokenizers.path(model)))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of every whole text with the end id, spans and the text decoded again: key, ids, begins, ends, decoded.

    Id number i stands for the UTF-8 bytes ``begins[i]`` to ``ends[i]`` of the text; the end id and the space mark put in
    front have empty spans, and of several byte ids of one code point the last has its bytes. A NULL or empty text has the
    end id alone. Rows that repeat, NULL keys and other columns of ``docs`` change nothing; an empty table gives one.
    """
    kind = docs.schema[key].dataType
    numbers = ArrayType(IntegerType(), False)
    schema = StructType([StructField(key, kind), *(StructField(c, numbers) for c in ("ids", "begins", "ends")), StructField("decoded", StringType())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                columns: list[list[np.ndarray]] = [[], [], []]
                decoded = []
                for (ids, begin, end), source in zip(known.encode(texts[a:b]), texts[a:b]):
                    size = len(source.encode())
                    for column, values, last in zip(columns, (ids, begin, end), (known.end_id, size, size)):
                        column.append(np.append(values, last).astype(np.int32))
                    decoded.append(known.processor.decode(columns[0][-1].tolist()))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[0]])]), pa.int32())
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *arrays, pa.array(decoded, pa.string())],
                                                 [key, "ids", "begins", "ends", "decoded"])

    return docs.select(key, text).mapInArrow(convert, schema)


def piece_digest(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_bytes, the source bytes that its pieces cover."""
    coded = encode(docs, model)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"),
                        F.element_at("ends", -1).cast("long").alias("n_bytes"))
