"""Spelling variants against plain Python on small tables, and the pivots' promise on random words."""
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from quadrat.llm import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, ratio=2):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            n[low[:h % len(low)] + low[h % len(low) + 1:] if h % 97 == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if v and max(n[x] for x in v) >= ratio * n[w] else None for w, v in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def random_words(rng, n, letters="abé"):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(n // 2)]
    for w in words[:]:
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        words.append(w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 2):])
    return sorted({w for w in words if len(w) >= 4})


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        word = random_words(rng, 2)[0]
        order = {g: k for k, g in enumerate(sorted({word[i:i + 2] for i in range(len(word) - 1)}, key=lambda g: rng.random()))}
        cost = [rng.randint(1, 9) for _ in order]
        grams = variants.prefix(word, order)
        found = variants.pivots(grams, cost)
        pairs = [(a, b) for a in grams for b in grams if b[1] - a[1] >= 2]
        assert tuple(found) in pairs and sum(cost[g[0]] for g in found) == min(cost[a[0]] + cost[b[0]] for a, b in pairs)


def test_no_near_pair_is_missed(spark):
    rng = random.Random(2)
    for letters in ("ab", "abcdé"):
        words = random_words(rng, 300, letters)
        got = variants.near_pairs(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")).collect()
        want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        assert all(words[r.a_n] == r.a and words[r.b_n] == r.b for r in got)


def test_long_chains_reach_their_last_form(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)] + [("x", "w3"), ("y", "z")], "word string, form string")
    got = {r.word: r.root for r in variants.roots(forms).collect()}
    assert got == {**{f"w{k}": "w40" for k in range(40)}, "x": "w40", "y": "z"}


def test_table_with_odd_rows(spark):
    rng = random.Random(4)
    words = random_words(rng, 120) + ["ÀÉxyz", "Éàabé", "HELLO", "hello", "hellos", "helo"]
    text = " ".join(rng.choices(words, [1 / (k % 17 + 1) for k in range(len(words))], k=2500)) + "."
    rows = [(None, "hello hellos Hello"), (1, None), (2, ""), (3, "hello " * 3000 + "hallo1hallo2hallo"), (3, "hello " * 3000 + "hallo1hallo2hallo"),
            (4, "x" * 100_000), (5, "a b 12 ü漢 ab×cd÷ef " * 9)] + [(k, text[k::1][:4000]) for k in range(10, 20)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.group_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert any(r[1] for r in got) and any(r[1] != r[2] for r in got if r[1])
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    sql = con.sql(variants.SQL).fetchall()
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(sql, key=str) == sorted(got, key=str), names
    assert variants.group_variants(docs.where("false")).count() == 0
    assert variants.group_variants(docs.where("doc_id < 3")).count() == 0
