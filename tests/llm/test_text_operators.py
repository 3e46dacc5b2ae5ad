"""Operators on documents against brute force, with NULLs, empty and long texts, ties, repeated rows and empty tables."""
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrat.llm import fingerprints, language, mixing, near_dup, packing, substring, token_store, toxicity
from quadrat.llm import encoding
from quadrat.llm.encoding import Encoder
from quadrat.llm.words import run_hashes
from quadrat.session import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part string, rank int"


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "be", "con", "der", "en", "for", "ge", "ha"], k=rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(11)
    base, passage = prose(rng, 300), prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [base, base, base.upper(), base + " tail words here", " ".join(base.split()[3:]), base.replace("con", "kon", 2)]
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 40) for _ in range(5)] + [passage, passage + "\n" + passage]
    texts += [None, "", "   \n\t ", "one", "one two three four", "One two THREE four", "é" * 5000, prose(rng, 9000), "a  b\n\n c   d\x1ce", "<|endoftext|> İ,"]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), None if t is None else len(t), "x", "y", i) for i, t in enumerate(texts)]
    return rows + [rows[5]] + [(None, prose(rng, 70), "en", "s1", 5, "x", "y", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@functools.cache
def library(vocabulary):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return tokenizer


def encoded(text, vocabulary, end):
    return np.array([*library(vocabulary).encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("vocabulary,keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(vocabulary, keeps_space):
    rng = random.Random(3)
    alphabet = "ab 'sS\n\t\x1c \u0085́éßİΣ1½.!,\U0001F600 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [r[1] or "" for r in corpus()]
    ours = Encoder(vocabulary, keeps_space).encode(texts)
    assert [x.tolist() for x in ours] == [encoded(t, vocabulary, 0)[:-1].tolist() for t in texts]


@pytest.mark.parametrize("vocabulary,keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_strings_of_special_tokens_and_long_chunks(vocabulary, keeps_space, monkeypatch):
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|> a", "<|startoftext|>", "<| endoftext |>", "ab" * 5000 + "!" * 5000 + " c", "!" * 400 + " d" + "?" * 400]
    own = Encoder(vocabulary, keeps_space)
    assert [x.tolist() for x in own.encode(texts)] == [encoded(t, vocabulary, 0)[:-1].tolist() for t in texts]
    assert max(map(len, [*own.whole, *own.tails, *own.after_space])) <= encoding.LONG and own.held > 0
    monkeypatch.setattr(encoding, "REMEMBER", 10)
    assert [x.tolist() for t in texts for x in own.encode([t])] == [encoded(t, vocabulary, 0)[:-1].tolist() for t in texts] and own.held <= 10
    text = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    text.encode_special_tokens = True
    as_text = Encoder(vocabulary, keeps_space, special_as_text=True).encode(texts)
    assert [x.tolist() for x in as_text] == [text.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_store_round_trip(spark, docs, none):
    folder = shared_folder(spark, "store")
    token_store.write_store(docs, folder, "word_bpe_49k.json")
    got = token_store.read_store(spark, folder).orderBy("start").collect()
    rows = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in corpus()))
    ids = [encoded(t, "word_bpe_49k.json", 1) for _, t in rows]
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in rows]
    assert [r.start for r in got] == (np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]).tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for x in ids]
    assert [x.tolist() for x in token_store.read_document(spark, folder, 15)] == [encoded(corpus()[5][1], "word_bpe_49k.json", 1).tolist()] * 2
    assert token_store.read_document(spark, folder, 16) == []
    empty = shared_folder(spark, "store")
    token_store.write_store(none, empty, "word_bpe_49k.json")
    assert token_store.read_store(spark, empty).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, capacity=64).toPandas()
    by_id = {}
    for r in corpus():
        by_id.setdefault(r[0], []).append(encoded(r[1], "byte_bpe_50k.json", 0))
    for r in got.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.ids_crc32 in {zlib.crc32(x[r.start:r.start + r.length].tobytes()) for x in by_id[key]}
    assert got["length"].sum() == sum(len(x) for v in by_id.values() for x in v)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(none).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 80))), reverse=True)
        room = []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(capacity - n)
        plan = packing.plan_bins({n: lengths.count(n) for n in lengths}, capacity)
        used = {}
        for length, low, high, first, per_bin, _ in plan:
            for rank in range(high - low):
                used[first + rank // per_bin] = used.get(first + rank // per_bin, 0) + length
        assert sorted(capacity - r for r in room) == sorted(used.values())


def test_mixing(docs, none):
    got = mixing.shares(docs.select("doc_id", "source", mixing.n_words("text").alias("size")), range_rows=5).toPandas()
    sizes = {}
    for r in corpus():
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    names = sorted(k for k in sizes if k) + [None]
    weights, capped = dict(zip(names, (5.0, 2.0, 1.0))), {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = sum(w for k, w in weights.items() if k not in capped)
        over = [k for k in names if k not in capped and left * weights[k] / free > 3 * sizes[k]]
        if not over:
            break
        capped |= {k: 3 * sizes[k] for k in over}
    target = {k: capped.get(k, left * weights[k] / free) for k in names}
    for name, rows in got.groupby("source", dropna=False):
        name = name if isinstance(name, str) else None
        assert rows["source_size"].eq(sizes[name]).all() and np.allclose(rows["target"], target[name])
        assert rows["taken"].sum() == int(target[name] + 1e-6)
        assert (rows["taken"] <= 3 * rows["size"]).all()
    mixed = mixing.mix(docs).toPandas()
    assert list(mixed.columns) == docs.columns
    assert sum(len(WORD.findall(t)) for t in mixed["text"]) == got["taken"].sum()
    assert mixing.mix(none).count() == 0


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(i, []).append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return sets, least


@pytest.mark.parametrize("block", [192, 2])
def test_near_duplicates(docs, none, block):
    got = near_dup.near_duplicates(docs, 85, block=block).toPandas()
    sets, least = groups([(r[0], r[1]) for r in corpus() if r[0] is not None], 85)
    assert len(got) == len(corpus())
    for r in got.itertuples():
        if r.doc_id != r.doc_id:
            assert r.kept and r.component_id != r.component_id
            continue
        assert (r.component_id, r.kept) == (least[r.doc_id], least[r.doc_id] == r.doc_id)
        assert r.n_shingles == len(sets[r.doc_id][0])
    kept = near_dup.drop_near_duplicates(docs, 85)
    assert kept.columns == docs.columns and kept.count() == got["kept"].sum()
    assert near_dup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [192, 1])
def test_near_copies_of_each_text_of_a_repeated_id(spark, block):
    rng = random.Random(15)
    one, two, three = prose(rng, 200), prose(rng, 210), prose(rng, 190)
    rows = [(5, one), (5, two), (6, one + " tail"), (7, two + " tail"), (1, three), (9, two), (9, three + " tail"), (20, prose(rng, 50)), (20, "")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 85, block=block).collect()
    _, least = groups(rows, 85)
    assert len(got) == len(rows) and all((r.component_id, r.kept) == (least[r.doc_id], least[r.doc_id] == r.doc_id) for r in got)
    assert set(least.values()) == {1, 20}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
    one, two, tiny = near_dup.super_minhash([a, b, a[:1]], 240)
    assert abs((one == two).mean() - 0.6) < 0.12
    assert np.array_equal(one, near_dup.super_minhash([a[::-1]], 240)[0])
    assert np.isfinite(tiny).all() and sorted(np.floor(tiny)) == list(range(240))


def removal(rows):
    seen, out = {}, {}
    for i in sorted({r[0] for r in rows}):
        for _, text in [r for r in rows if r[0] == i]:
            w = WORD.findall(text or "")
            gone = [False] * len(w)
            for k in range(len(w) - 49):
                if seen.setdefault(tuple(w[k:k + 50]), i) < i:
                    gone[k:k + 50] = [True] * 50
            out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(docs, none):
    want = removal([(r[0], r[1]) for r in corpus() if r[0] is not None])
    got = substring.removal_digest(docs).toPandas()
    assert len(got) == len(corpus())
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.where("doc_id is not null").collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == want[r.doc_id][2]
    assert substring.removal_digest(none).count() == 0 and substring.remove_repeats(none).count() == 0


def test_ids_that_repeat_with_other_words(spark):
    rng = random.Random(4)
    first, second = prose(rng, 120), prose(rng, 130)
    rows = [(1, first), (2, second), (2, prose(rng, 90)), (3, first[:400] + " " + second), (3, prose(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.removal_digest(docs).collect())
    assert [r[2] for r in got if r[0] < 3] == [0, 0, 0] and [r[2] > 150 for r in got if r[0] == 3].count(True) == 1


def test_all_texts_of_a_repeated_id_own_their_words(spark):
    rng = random.Random(14)
    one, two = prose(rng, 120), prose(rng, 130)
    later = [(2, prose(rng, 20) + " " + one + " " + prose(rng, 20)), (3, prose(rng, 20) + " " + two + " " + prose(rng, 20)), (4, one + " " + prose(rng, 5) + " " + two)]
    docs = spark.createDataFrame([(1, one), (1, two), *later], "doc_id long, text string").coalesce(1)
    want = removal([(1, one), (1, two), *later])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(docs).where("doc_id > 1").collect()}
    assert got == {i: want[i] for i in (2, 3, 4)} and [got[i][1] for i in (2, 3, 4)] == [120, 130, 250]


def test_small_slices_and_automata_change_nothing(spark, docs, monkeypatch):
    want = sorted(substring.removal_digest(docs).collect(), key=str)
    monkeypatch.setattr(substring, "SLICE", 2)
    monkeypatch.setattr(substring, "AUTOMATON", 200)
    assert sorted(substring.removal_digest(docs).collect(), key=str) == want


def test_texts_of_repeated_words(spark):
    rng = random.Random(15)
    flat = "word " * 100_000
    rows = [(1, "word " * 300 + prose(rng, 60)), (2, flat), (3, prose(rng, 10) + " " + "word " * 60 + prose(rng, 10)), (4, "a b " * 5000), (5, "b a " * 40)]
    got = {r.doc_id: r.n_removed for r in substring.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 100_000, 3: 60, 4: 0, 5: 80}
    small = [(i, t[:2000]) for i, t in rows]
    want = removal(small)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal_digest(spark.createDataFrame(small, "doc_id long, text string")).collect()} == want


def test_run_hashes_are_equal_for_equal_runs():
    x = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    y = np.concatenate([x[500:900], x])
    assert np.array_equal(run_hashes(y, 50)[:351], run_hashes(x, 50)[500:851])
    assert len(run_hashes(x[:49], 50)) == 0


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_digest(docs).toPandas()
    rows = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in corpus()))
    want = sorted((i, len(t), hashlib.sha256((t[:len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][:len(t) // 4]).encode()).hexdigest()) for k, (i, t) in enumerate(rows))
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.n_chars, r.edited_sha256) for r in got.itertuples()) == want
    long = got[got["n_chars"] > 300]
    assert long["near_edited"].mean() > long["near_next"].mean()
    assert fingerprints.fingerprint_digest(none).count() == 0
    one = fingerprints.fingerprint_digest(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_common_extension():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert fingerprints.common_extension(fingerprints.Prefixes(fingerprints.code_points(a)), i, fingerprints.Prefixes(fingerprints.code_points(b)), j) == n


def labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        toxic, lang = int(i % 5 == 0), ["en", "de", "fr"][i % 3]
        stock = {"en": "the of and thing with stone", "de": "der und nicht ein schein stück", "fr": "le de un été garçon sur"}[lang].split()
        words = [rng.choice(stock) for _ in range(rng.randint(5, 60))] + (["vermin", "scoundrel"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, "s", 1, "x", "y", 1))
        labels.append((i, 1, toxic))
    rows += [(1000, None, None, None, None, None, None, None), (1001, "", "en", "s", 0, "x", "y", 1), (1002, "123 !!", None, "s", 6, "x", "y", 1), rows[0]]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_the_held_out_fold(spark, none):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_digest(docs, labels).toPandas()
    assert len(got) == 604 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 600)]
    assert ((held["doc_id"] % 5 == 0).astype(int) == held["predicted"]).mean() > 0.97
    assert (held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (got["predicted"] == 0).sum()
    assert toxicity.toxicity_digest(none, labels).count() == 0
    assert toxicity.toxicity_digest(docs, labels.where("false")).select("score").distinct().count() == 1


def test_pairs_of_terms_weigh_more_than_both():
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(np.array([0] * a + [1] * b + [2 + int(rng.integers(5))], np.int64))
        labels.append(float(a == b))
    machine = toxicity.FactorizationMachine(7).fit(texts, np.array(labels), epochs=60, step=0.3)
    margin, _ = machine.margins(np.concatenate(texts), np.repeat(np.arange(1500), [len(t) for t in texts]), 1500)
    assert ((margin > 0) == np.array(labels)).mean() > 0.95


def test_terms_that_tell_only_in_pairs_are_learned_from_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["gronk"] * a + ["mirpel"] * b + ["".join(rng.choices("abcdefgh", k=2)) for _ in range(20)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_digest(docs, marks).where("held_out").join(marks, "doc_id").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95


def test_scores_refer_to_the_natural_share_whatever_the_sample(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        weak = rng.random() < 0.3
        words = ["grumble"] * weak + ["".join(rng.choices("abcdefgh", k=2)) for _ in range(10)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(rng.random() < (0.3 if weak else 0.03))))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    low, high = (toxicity.train(docs, marks, n).scores(["grumble ab cd", "ab cd", None]) for n in (300, 4000))
    assert np.abs(low - high).max() < 0.1 and abs(low[0] - 0.3) < 0.1 and low[1] < 0.1


def test_symbols_beyond_the_first_plane_are_no_letters():
    model = language.MixtureModel({"en": np.ones(1 << language.BITS), "de": np.ones(1 << language.BITS)})
    assert model.predict("\U0001F600 12 \U0001F680\U0001F4A9") == ("und", 0.0, [], [])
    assert np.array_equal(language.trigrams("one \U0001F600 two"), language.trigrams("one two"))
    assert len(language.trigrams("\U00010400\U00020000")) == 2  # a Deseret letter and an ideograph


def test_language_mixtures(spark, none):
    docs, _ = labelled(spark)
    got = language.language_digest(docs).toPandas().set_index("doc_id")
    held = got[got["held_out"] & (got.index < 600)]
    assert (held["lang_pred"] == [["en", "de", "fr"][i % 3] for i in held.index]).mean() > 0.97
    assert list(got.loc[[1000, 1001, 1002], "lang_pred"]) == ["und"] * 3 and got["score"].between(0, 1).all()
    model = language.train(docs)
    name, share, names, shares = model.predict("the of and thing with stone " * 6 + "der und nicht ein schein stück " * 12)
    assert name == "de" and set(names) == {"de", "en"} and 0.5 < share < 0.8 and abs(sum(shares) - 1) < 1e-6
    assert language.language_digest(none).count() == 0
    assert language.language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect() == [("und",)]
