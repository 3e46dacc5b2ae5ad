"""Piece encoding against the library: ids, byte spans, decoded texts, and normalisation by other compiled maps."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from quadrat.llm import pieces

MODEL = "piece_bpe_32k.model"
ODD = ["", "  ", " ", "a", "hello  world", "▁▁ x", "x▁", "<0x41>", "</s> <unk>", "\n\n a\n", "é", "🙂 漢 \0", "a.b, c!? 'd'", "x" * 5000,
       " " * 300, "\n" * 300, "ab" * 40 + " " + "héé" * 30]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = "ab theé ▁\n\t🙂漢字  <s></s>ß\xa0　ﬁ\0\r.,!?'\"0123"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def known():
    return pieces.Pieces(public_tokenizers.path(MODEL))


def test_ids_and_spans_are_those_of_the_library(known):
    texts = ODD + random_texts(2000)
    for text, (ids, begin, end) in zip(texts, known.encode(texts)):
        want = known.processor.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], text
        assert list(zip(begin.tolist(), end.tolist())) == [(p.begin, p.end) for p in want], text


def test_many_merges_at_once_equal_one_by_one(known):
    words = sorted({w for t in random_texts(300, 8) for w in known.chunks.findall(known.normalized(t)[0]) if len(w) <= pieces.SHORT})
    for word in words:
        assert "".join(known.merged(word)) == word
    fresh = pieces.Pieces(public_tokenizers.path(MODEL))
    fresh._learn(words, 3)
    for word in words:
        ids = fresh._spread(np.array([fresh.known[3][word]]))[0].tolist()
        assert ids == [i for p in known.merged(word) for i in ([known.ids[p]] if p in known.ids else [known.bytes[b] for b in p.encode()])]


def test_forgetting_changes_nothing(known, monkeypatch):
    texts = random_texts(60, 5)
    want = [x[0].tolist() for x in known.encode(texts)]
    monkeypatch.setattr(pieces, "REMEMBER", 0)
    assert [known.encode([t])[0][0].tolist() for t in texts] == want
    assert known.weight == 0 and not known.known[1]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("extra", [False, True])
def test_longest_prefix_normalisation_keeps_sources(rule, prefix, extra):
    library = SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=extra)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Pieces(public_tokenizers.path(MODEL))
    own.rules, own.map = proto.normalizer_spec, pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in [t.replace("\0", "") for t in ODD + random_texts(400, 9)]:
        norm, source = own.normalized(text)
        want, places = library.normalize(text, with_offsets=True)  # code points of the source per normalised code point
        assert norm == want
        if source is not None:
            starts = np.cumsum([0] + [len(c.encode()) for c in norm])
            assert [len(text.encode()[:b].decode()) for b in source[starts]] == places


def test_table_with_odd_rows(spark):
    texts = [None, "", "Hello world", "Hello world", "word " * 30_000, "a ▁ b"]
    docs = spark.createDataFrame([(i if i != 3 else 2, t, "z") for i, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.decoded): r for r in pieces.encode(docs, MODEL).collect()}
    library = SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    assert len(got) == 6  # the repeated row gives the same row again
    for i, text in [(0, ""), (1, ""), (2, "Hello world"), (4, texts[4]), (5, None), (None, "x")]:
        source = texts[5] if i == 5 else text
        ids = library.encode(source) + [library.eos_id()]
        row = got[i, library.decode(ids)]
        assert row.ids == ids and row.ends[-1] == len(source.encode())
    digest = {r.doc_id: r for r in pieces.piece_digest(docs).collect()}
    ids = library.encode(texts[4]) + [2]
    assert digest[4].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest[4].n_tokens == len(ids)
    assert digest[4].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert digest[0].n_tokens == 1 and digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.piece_digest(docs.where("false")).count() == 0
