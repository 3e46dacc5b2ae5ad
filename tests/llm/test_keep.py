"""What a worker keeps."""
import sys

from quadrat.llm import encoding, substring, toxicity, words


def shelf():
    return {k for k in vars(sys.modules["quadrat_kept"]) if not k.startswith("__")}


def test_another_kind_lets_go_of_the_rest():
    toxicity.terms("some words here")
    assert shelf() == {"toxicity terms"}
    substring.anchors(words.word_numbers(words.split_words("a b c " * 40)))
    assert shelf() == {"words numbers", "words powers"}
    encoding.encoder("word_bpe_49k.json", False).encode(["a b"])
    assert shelf() == {"encoder word_bpe_49k.json False"}


def test_long_words_are_not_kept():
    found = words.word_numbers([b"x" * 500, b"short", b"x" * 500])
    assert found[0] == found[2] and b"x" * 500 not in vars(sys.modules["quadrat_kept"])["words numbers"]
    assert (toxicity.terms("y" * 500) == toxicity.terms("y" * 500)).all()
    assert all(len(w) <= 100 for w in vars(sys.modules["quadrat_kept"])["toxicity terms"])


def test_words_of_a_worker_are_few():
    assert words.REMEMBER <= 50_000
    many = [b"w%d" % i for i in range(120_000)]
    found = [words.word_numbers(many[at:at + 500])[0] for at in range(0, len(many), 500)]
    assert len(vars(sys.modules["quadrat_kept"])["words numbers"]) <= 50_500
    assert found == [words.word_numbers(many[at:at + 1])[0] for at in range(0, len(many), 500)]
