"""Vector codes: trees against comparing every point with every entry, and the table against plain Python."""
import hashlib
import math

import duckdb
import numpy as np
import pytest

from quadrat.llm import vector_codes
from quadrat.llm.vector_codes import CoverTree


def cases():
    rng = np.random.default_rng(1)
    for kind in range(30):
        n = int(rng.integers(1, 1500))
        points = rng.integers(-40, 40, (n, 4)) if kind % 2 else (rng.normal(size=(n, 4)) * 300).astype(np.int64)
        if kind % 3 == 0:
            points[:n // 2] = points[0]
        yield points, points[:64] if kind % 4 else rng.integers(-40, 40, (64, 4))


def test_trees_assign_as_full_comparison():
    for points, entries in cases():
        tree = CoverTree.build(points)
        codes, errors = tree.assign(entries)
        squares = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (codes == squares.argmin(1)).all() and (errors == squares.min(1)).all()
        sums, counts = tree.totals(entries)
        want = np.zeros_like(entries)
        np.add.at(want, codes, points)
        assert (sums == want).all() and (counts == np.bincount(codes, minlength=len(entries))).all()
        again = CoverTree.unpacked(points, tree.packed())
        assert all((x == y).all() for x, y in zip(again.totals(entries), (sums, counts)))


def test_tree_covers_its_points():
    points = (np.random.default_rng(5).normal(size=(2000, 4)) * 100).astype(np.int64)
    tree = CoverTree.build(points)
    assert sorted(tree.order) == list(range(2000))
    for k in range(len(tree.start)):
        held = points[tree.order[tree.start[k]:tree.stop[k]]]
        assert (((held - points[tree.centre[k]]) ** 2).sum(1) <= tree.radius[k] ** 2).all()
        if tree.children[k]:
            own = range(tree.first_child[k], tree.first_child[k] + tree.children[k])
            assert sum(tree.stop[c] - tree.start[c] for c in own) == len(held)
            assert all(tree.radius[c] <= tree.radius[k] / 2 * (1 + 1e-6) for c in own)


def test_most_points_are_assigned_in_subtrees():
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (64, 4))
    points = centres[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, (4000, 4))
    wide = [b - a for starts, stops, _ in CoverTree.build(points)._decided(centres) for a, b in zip(starts, stops)]
    assert sum(wide) == 4000 and len(wide) < 400


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(row)] for row in cut]

    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                held = [cut[r][p] for r in range(len(cut)) if now[r][p][1] == e]
                if held:
                    books[p][e] = tuple(sum(c) // len(held) for c in zip(*held))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in row) for row in assign()]
    by_label = {}
    for (_, label, _), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in row), e, by_label[label], digest) for (i, label, _), row, e in zip(kept, assign(), errors)]


def test_table_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=64).astype(np.float32)], int(i) % 4 if i % 5 else None) for i in rng.permutation(150)]
    rows += [rows[0], rows[0], (None, rows[1][1], 2), (7, rows[2][1], 1), (900, None, 1), (901, [None] * 64, 1), (902, [math.nan] * 64, 1), (903, [math.inf] * 64, 1),
             (2 ** 60 + 1, [0.0] * 64, 3), (2 ** 60 + 3, [-1e-9] * 64, 3)] + [(2000 + i, rows[5][1], 9) for i in range(80)]
    vectors = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = [tuple(r[c] for c in names) for r in vector_codes.code_digest(vectors.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    con = duckdb.connect()
    path = vectors.select("vec_id", "embedding", "label").toArrow()
    con.register("embeddings", path)
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({vector_codes.SQL})").fetchall(), key=str) == sorted(got, key=str)


def test_small_and_unfit_tables(spark):
    kinds = "vec_id long, embedding array<double>, label string"
    table = lambda *rows: spark.createDataFrame(list(rows), kinds)
    assert vector_codes.code_digest(table()).count() == 0
    assert vector_codes.code_digest(table((1, None, "a"))).count() == 0
    one = vector_codes.code_digest(table((1, [0.5] * 32, None))).first()
    assert one.code == "00" * 16 and one.error == 0 and one.label_error == 0
    assert vector_codes.code_digest(table((1, [], "a"))).first().code == "00" * 16
    for rows in ([(1, [1.0] * 32, "a"), (2, [1.0] * 16, "a")], [(1, [1.0] * 20, "a")], [(1, [1e300] * 32, "a")]):
        with pytest.raises(ValueError):
            vector_codes.compress(table(*rows))
