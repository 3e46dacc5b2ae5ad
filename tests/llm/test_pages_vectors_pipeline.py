"""Page extraction, nearest neighbours and the pipeline."""
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quadrat.llm import html_text, neighbours
from quadrat.llm.html_pages import labelled_page


@pytest.fixture(scope="module")
def field():
    return html_text.train()


def test_blocks_are_read_as_written():
    page = '<html><head><title>t</title><script>"</p>"</script></head><body>a&amp;b <b>c</b><br>d<p>e<p>f <a href="x>y">g</a></div><ul><li>h<li>i</ul><!-- <p>no --> &nbsp; </body>'
    assert [b.text for b in html_text.leaf_blocks(page)] == ["a&b c d", "e", "f g", "h", "i"]
    assert html_text.leaf_blocks(None) == [] == html_text.leaf_blocks("")
    assert [b.text for b in html_text.leaf_blocks("<div>open <p>never closed <script>x")] == ["open", "never closed"]


def test_head_without_its_end_and_formulas():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<html><head><title>x</title><meta charset=u><style>p{}</style><h1>T</h1><p>Some text.") == ["T", "Some text."]
    assert texts("<head><title>x</title>\n<b>Bold</b> start<p>more") == ["Bold start", "more"]
    assert texts("<head><title>x</title>plain<p>more") == ["plain", "more"]
    assert texts("<head><template><p>no</p></template><title>x</title></head><body><p>yes") == ["yes"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><svg><text>label</text><path d=z /></svg>") == ["Let x=1 be.", "label"]


def test_labels_of_layouts_not_seen(field):
    right = total = 0
    for seed in range(20_000, 20_200):
        page, known = labelled_page(seed)
        blocks = html_text.leaf_blocks(page)
        assert [b.text for b in blocks] == [t for t, _ in known]
        right += sum(a == y for a, (_, y) in zip(field.decode(html_text.features(blocks)), known))
        total += len(known)
    assert right / total > 0.98


def test_viterbi_finds_the_best_path(field):
    blocks = html_text.features(html_text.leaf_blocks(labelled_page(31_000)[0]))[:9]
    lifts = [field.weights[r].sum() for r in field._rows(blocks)]

    def value(path):
        return sum(x * y for x, y in zip(lifts, path)) + sum(field.pairs[a, b] for a, b in zip(path, path[1:]))

    paths = [[n >> k & 1 for k in range(len(blocks))] for n in range(1 << len(blocks))]
    assert np.isclose(value(field.decode(blocks)), max(map(value, paths)))


def test_extract(spark, field):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>T</h1><p>Some text\n here &lt;ok&gt;.</p></article><footer>© x</footer></body>"
    pages = spark.createDataFrame([(1, "u", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (None, "u", page, "z"), (1, "u", page, "z")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, field).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == sorted((i, t) for i, t in [(1, "T\n\nSome text here <ok>.")] * 2 + [(0, "T\n\nSome text here <ok>."), (2, ""), (3, "")])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages.where("false"), field).count() == 0


def brute(rows, asked, k):
    out = []
    for i, q in asked:
        near = sorted((-float(neighbours.exact_products(np.array([v]), np.array(q))[0]), j) for j, v in rows if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_neighbours_are_exact_within_the_pool(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 12) for i in range(60)]
    odd = [(2000, None), (2020, [0.0] * 12), (2040, [float("nan")] + [1.0] * 11), (2060, [float("inf")] + [1.0] * 11), (2080, [None] + [1.0] * 11)]
    table = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<double>")
    got = neighbours.search(table, table.where("vec_id % 20 = 0"), k=5)
    want = brute(rows, [(i, v) for i, v in rows if i % 20 == 0], 5)
    assert sorted(map(tuple, got.collect())) == want
    assert neighbours.search(table.where("false"), table).count() == 0
    few = table.where("vec_id in (0, 1, 2)")
    assert few.transform(lambda t: neighbours.search(t, t, k=5)).count() == 6


def test_probing_ends_between_two_distances():
    codes = np.random.default_rng(4).integers(0, 256, (3000, 16)).astype(np.uint8)
    block, looked = neighbours.IndexBlock(codes), []

    class Counted(list):
        def __getitem__(self, value):
            looked.append(len(super().__getitem__(value)))
            return super().__getitem__(value)

    block.buckets = [Counted(b) for b in block.buckets]
    for code in codes[:20]:
        far = np.bitwise_count(codes ^ code).sum(1)
        radius = np.sort(far)[99]
        looked.clear()
        assert np.array_equal(np.sort(block.within(code, 100)), np.flatnonzero(far <= radius))
        t = radius // 16  # probing all substrings at this distance completes a radius that is larger than needed
        if radius % 16 < neighbours.TOGETHER:
            assert sum(looked) < sum((np.bitwise_count(codes[:, k] ^ code[k]) <= t).sum() for k in range(16))
    assert any(np.sort(np.bitwise_count(codes ^ c).sum(1))[99] % 16 < neighbours.TOGETHER for c in codes[:20])


def test_rough_products_lose_no_neighbour():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 12)), 5, 0) * (1 + rng.integers(-2, 3, (200, 1)) * 2.0 ** -52)
    for row in rng.normal(size=(30, 12)):
        near, score = neighbours._best(x, np.arange(200), row, 20, float(np.sqrt(row @ row) * np.sqrt((x * x).sum(1).max()) * 1e-14 * 20))
        exact = neighbours.exact_products(x, row)
        assert set(np.flatnonzero(exact >= np.sort(exact)[-20])) <= set(near) and (score == exact[near]).all() and len(near) < 200


def test_recall_and_radius(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 32))
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(4000), "embedding": x.tolist()}))
    got = neighbours.search(table, table.where("vec_id % 100 = 0"), k=20, pool=600, index_block=2000).toPandas()
    hits = 0
    for i in range(0, 4000, 100):
        score = x @ x[i]
        score[i] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(got[got["query_id"] == i]["vec_id"]))
    assert hits / 800 >= 0.9
    code = neighbours.codes(neighbours.lifted(x, 20.0), neighbours.learn_rotations(neighbours.lifted(x[:500], 20.0)))
    block = neighbours.IndexBlock(code)
    distance = np.bitwise_count(code ^ code[7]).sum(1)
    found = block.within(code[7], 50)
    assert len(found) >= 50 and set(found) == set(np.flatnonzero(distance <= distance[found].max()))


def test_pipeline_stages(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(i, f"{base} own{i}" if i < 4 else " ".join(f"w{i}x{k}" for k in range(60)), "en", "a" if i % 2 else None, 1) for i in range(30)]
    docs = spark.createDataFrame(rows + [(90, None, None, None, None), (91, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {0, *range(4, 30), 90, 91}
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    assert {r.doc_id: r.text for r in cut.collect()}[2] == "own2" and cut.count() == docs.count()
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
