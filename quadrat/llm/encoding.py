"""Fast exact tokenization of many texts: a text falls into chunks that a tokenizer treats alone, and chunks repeat."""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quadrat.llm.keep import kept

#: White space as the vocabularies' patterns see it is that of Python without the four information separators.
_CHUNKS = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: White space but space and line feed.
_OTHER_SPACE = "\t\v\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words that a pattern keeps whole: letters with one lower-case letter each.
_LETTERS = re.compile(r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f]+")
#: A letter (that stays one in lower case) before ASCII punctuation ends a token, so that a chunk's closing marks can be encoded alone.
_TAIL = re.compile(r"([^!-/:-@\[-`{-~]*(?=[A-\u012f])[^\W\d_])([!-/:-@\[-^`{-~]+)")

#: Bytes of chunks and ids that one Python worker remembers, about, counted with what a table entry costs; beyond, it starts
#: anew. Chunks of more characters than ``LONG`` are forgotten after the texts they are in.
REMEMBER, ENTRY, LONG = 192 << 20, 200, 300


def _lowered(text: str) -> str:
    """Lower case where it changes letters one by one and normal form changes none, so that a lower-casing vocabulary's ids
    stay as they are; other texts as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Ids of texts under a vocabulary file of the ``tokenizers`` library, as little-endian unsigned 32-bit integers.

    ``keeps_space``: the vocabulary encodes white space (byte level), which goes with the word after it; else it is
    dropped and letters are lower-cased. No token of either kind reaches back over the start of a white-space run, so texts are cut there and each
    different chunk is encoded once. Strings of special tokens become these tokens, as the library has it, and texts with one go
    to the library whole; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, vocabulary: str, keeps_space: bool, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = special_as_text
        added = [] if special_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added), re.I) if added else None  # in any case, as chunks are lower-cased first
        self.model = self.tokenizer.model
        self.keeps_space = keeps_space
        printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level vocabularies print other bytes as U+0100 on
        hidden = [b for b in range(256) if b not in printed]
        self.letters = str.maketrans({b: 256 + k for k, b in enumerate(hidden)})
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.whole: dict[str, bytes] = {}  # chunks as they are
        self.tails: dict[str, bytes] = {"": b""}
        self.after_space: dict[str, bytes] = {}  # chunks after one space, which the key leaves out
        self.long: list[tuple[dict[str, bytes], str]] = []
        self.held = 0

    def encode(self, texts: list[str], at_once: int = 256) -> list[np.ndarray]:
        return [ids for at in range(0, len(texts), at_once) for ids in self._encode(texts[at:at + at_once])]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.special:
            for i, text in enumerate(texts):
                if self.special.search(text):
                    out[i] = np.frombuffer(self._whole([text])[0], "<u4")
        plain = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain])):
            out[i] = ids
        while self.long:
            known, chunk = self.long.pop()
            del known[chunk]
        if self.held > REMEMBER:
            self._forget()
        return out

    def _encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.keeps_space:
            even, parts = [], []
            for i, text in enumerate(texts):
                if not any(c in text for c in _OTHER_SPACE):
                    part = text.replace("\n", " \n").split(" ")
                    if "" not in part and "\n" not in part:  # single white space between words
                        even.append(i)
                        parts.append(part)
            heads = self._look_up([[p[0]] for p in parts], self.whole, False)
            tails = self._look_up([p[1:] for p in parts], self.after_space, True)
            for i, head, tail in zip(even, heads, tails):
                out[i] = np.frombuffer(head + tail, "<u4")
            rest = [i for i, x in enumerate(out) if x is None]
            parts = [_CHUNKS.findall(texts[i]) for i in rest]
        else:
            rest, parts = range(len(texts)), [_lowered(t).replace("\n", " ").split(" ") for t in texts]
        for i, found in zip(rest, self._look_up(parts, self.whole, False)):
            out[i] = np.frombuffer(found, "<u4")
        return out

    def _look_up(self, parts: list[list[str]], known: dict[str, bytes], spaced: bool) -> list[bytes]:
        keys = [k for p in parts for k in p]
        found = list(map(known.get, keys))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            self._learn({keys[i] for i in gaps}, known, " " if spaced else "")
            for i in gaps:
                found[i] = known[keys[i]]
        out, at = [], 0
        for p in parts:
            out.append(b"".join(found[at:at + len(p)]))
            at += len(p)
        return out

    def _learn(self, new: set[str], known: dict[str, bytes], space: str) -> None:
        """Ids of new chunks. A single word goes to the vocabulary's model at once, others through all steps."""
        model, lower, table = self.model, not self.keeps_space, self.letters
        front, odd = space.translate(table), []
        for chunk in new:
            stem, tail = chunk, b""
            if chunk and not chunk[-1].isalnum() and (m := _TAIL.fullmatch(chunk)):
                stem, tail = m.groups()
                if tail not in self.tails:  # long ones are not kept
                    found = self._whole([tail])[0]
                    if len(tail) <= LONG:
                        self.tails[tail] = found
                        self.held += ENTRY + len(tail) + len(found)
                tail = self.tails.get(tail) if len(tail) <= LONG else found
            if stem.isascii() and stem.isalpha():
                piece = front + (stem.lower() if lower else stem)
            elif _LETTERS.fullmatch(stem):
                piece = front + (stem.lower() if lower else stem).encode().decode("latin-1").translate(table)
            else:
                odd.append(chunk)
                continue
            known[chunk] = array("I", [t.id for t in model.tokenize(piece)]).tobytes() + tail
        known.update(zip(odd, self._whole([space + c if c[:1] != "\n" else c for c in odd])))
        for chunk in new:
            if len(chunk) > LONG:
                self.long.append((known, chunk))
            else:
                self.held += ENTRY + len(chunk) + len(known[chunk])

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]


def encoder(vocabulary: str, keeps_space: bool) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return kept(f"encoder {vocabulary} {keeps_space}", lambda: Encoder(vocabulary, keeps_space))
