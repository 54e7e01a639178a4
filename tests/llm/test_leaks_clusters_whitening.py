"""Decontamination, clustering and whitening on small tables with odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pytest

from coldledger.llm import clustering, decontamination, jacobi_davidson, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_report(docs, items, window=10):
    """doc_id, n_words, n_hit, sorted ids of each document."""
    windows = {}
    for item_id, text in items:
        words = words_of(text)
        size = min(len(words), window)
        for start in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[start : start + size]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    found = []
    for doc_id, text in docs:
        words, hit, ids = words_of(text), set(), set()
        for size in sizes:
            for start in range(len(words) - size + 1):
                owners = windows.get(tuple(words[start : start + size]))
                if owners is not None:
                    hit.update(range(start, start + size))
                    ids |= owners
        found.append((doc_id, len(words), len(hit), sorted(str(i) for i in ids if i is not None)))
    return found


PASSAGE = "Alpha beta gamma-delta epsilon ZETA eta theta iota kappa lambda mu nu xi omicron"
ITEMS = [
    (1, PASSAGE),
    (1, PASSAGE),
    (12, PASSAGE.upper()),
    (2, "the the the the the the the the the the the the"),
    (3, "short one"),
    (4, "Single"),
    (5, None),
    (6, " .,;"),
    (None, "nameless item"),
    (7, "日本 語 été naïve Ärger ÄRGER 𝔘𝔫𝔦 x1 2y z3 w4"),
    (8, "a b a b a b a b a b a b a b"),
]
LONG = " ".join(f"w{i % 977}" for i in range(60_000)) + " " + PASSAGE + " " + "the " * 3000
DOCS = [
    (1, PASSAGE),
    (2, "before " + PASSAGE.replace(" ", "\n--\t") + " after"),
    (3, " ".join(PASSAGE.split()[:9])),
    (4, "the " * 9),
    (5, "the " * 10),
    (6, "the " * 25 + "single short one short one"),
    (7, None),
    (8, ""),
    (9, "\x00\x7f ``` {{"),
    (9, PASSAGE),
    (9, PASSAGE),
    (None, "a nameless item here"),
    (10, LONG),
    (11, "日本 語 été naïve Ärger ÄRGER 𝔘𝔫𝔦 x1 2y z3 w4"),
    (12, "a b a b a b a b a b a b a b a b a"),
    (13, PASSAGE + " " + PASSAGE + " beta " + " ".join(PASSAGE.split()[2:])),
    (14, "shortone short.One"),
]
DOC_SCHEMA = "doc_id long, text string, words string, `row` string, item int, pos int"
ITEM_SCHEMA = "item_id long, text string, place int, `row` string"


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "w", "r", 1, 2) for d in docs], DOC_SCHEMA),
        spark.createDataFrame([(*i, 1, "r") for i in items], ITEM_SCHEMA),
    )


def reported(report):
    return sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in report.collect()), key=str
    )


def expected(docs, items):
    return sorted(
        (
            (d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)
            for d, n, hit, ids in plain_report(docs, items)
        ),
        key=str,
    )


def test_decontamination(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    assert reported(decontamination.contamination_report(docs, items)) == expected(DOCS, ITEMS)


def test_decontamination_of_random_texts(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["a", "b", "c", "dd", "ee"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 14)))) for i in range(25)]
    found = decontamination.contamination_report(*tables(spark, docs, items))
    assert reported(found) == expected(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, items = tables(spark, DOCS, ITEMS)
    assert decontamination.contamination_report(docs.limit(0), items).count() == 0
    found = decontamination.contamination_report(docs, items.limit(0))
    assert reported(found) == expected(DOCS, [])


def test_phrase_matches_are_longest_runs(spark):
    docs, items = tables(spark, [(1, f"x {PASSAGE} y"), (2, "mu nu xi short one")], [(1, PASSAGE), (3, "short one")])
    index = decontamination.build_index(docs)
    numbered = decontamination.numbered_items(items)
    names = {r.item: len(r.words) for r in numbered.collect()}
    ids = {r.row: r.doc_id for r in decontamination.indexed_documents(index).collect()}
    found = decontamination.phrase_matches(index, numbered).collect()
    count = len(words_of(PASSAGE))
    assert sorted((ids[r.row], names[r.item], r.start, r.words, r.item_start) for r in found) == [
        (1, count, 1, count, 0),
        (2, 2, 3, 2, 0),
    ]


def test_proximity_matches(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(list("abcdefghij"), 40))) for i in range(20)]
    items = [(1, "a b c"), (2, "j j"), (3, "a z")]
    index = decontamination.build_index(tables(spark, docs, items)[0])
    numbered = decontamination.numbered_items(tables(spark, docs, items)[1])
    sought = {r.item: set(r.words) for r in numbered.collect()}
    ids = {r.row: r.doc_id for r in decontamination.indexed_documents(index).collect()}
    counts = {w: sum(words_of(t).count(w) for _, t in docs) for w in "abcjz"}
    wanted = set()
    for doc_id, text in docs:
        words = words_of(text)
        for item, need in sought.items():
            rarest = min(need, key=lambda w: (counts[w], w))
            for place, word in enumerate(words):
                if word == rarest and need <= set(words[max(0, place - 4) : place + 5]):
                    wanted.add((doc_id, item, place))
    found = [(ids[r.row], r.item, r.pos) for r in decontamination.proximity_matches(index, numbered, 4).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_decontamination_runs_no_python(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Python on the main path")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    docs, items = tables(spark, DOCS, ITEMS)
    plan = decontamination.contamination_report(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Vectors -----------------------------------------------------------------------------------

VEC_SCHEMA = "vec_id long, embedding array<float>, x int, cluster string, `row` string, n int"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "r", 2) for i, v in rows], VEC_SCHEMA)


def odd_vectors(count, size, seed):
    rng = np.random.default_rng(seed)
    vectors = [np.float32(v).tolist() for v in rng.standard_normal((count, size)) * rng.uniform(0.2, 2, size)]
    rows = list(enumerate(vectors))
    rows += [(900, vectors[0]), (3, vectors[3]), (None, vectors[4])]
    rows += [(901, None), (902, [None] + vectors[0][1:]), (903, [float("nan")] + vectors[0][1:])]
    return rows + [(904, vectors[0][1:] + [float("inf")]), (905, [])]


def plain_clusters(rows, clusters=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in drawn[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(t) // len(t) for t in zip(*members[k])] if k in members else c for k, c in enumerate(centroids)]
    last = [(i, *nearest(x)) for i, x in kept]
    return sorted(
        (
            (
                i,
                k,
                d,
                sum(e for _, e, j in last if j == k),
                sum(e for _, e, _ in last),
                hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest(),
            )
            for i, d, k in last
        ),
        key=str,
    )


@pytest.mark.parametrize("count", [5, 60])
def test_clusters(spark, count):
    rows = odd_vectors(count, 64, 3) + [(906, [1.0] * 63), (907, [0.0] * 65)]
    found = clustering.clustering_report(vector_table(spark, rows)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_clusters(rows)


def test_clusters_keep_empty_centroids_and_columns(spark):
    # Eight equal vectors: all go to centroid 0, the others stay where they are.
    rows = [(i, [0.5] * 64) for i in range(8)]
    found = clustering.cluster_vectors(vector_table(spark, rows))
    assert {r.cluster for r in found.collect()} == {0}
    assert found.first().kept_columns.cluster == "c"
    assert clustering.clustering_report(vector_table(spark, rows).limit(0)).count() == 0
    assert clustering.clustering_report(vector_table(spark, [(1, None), (2, [])])).count() == 0


def test_eigenpairs():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for spread in (np.linspace(1, 9, 40), [4.0] * 20 + [1.0] * 20, [3.0, 2.0] + [0.0] * 38, [0.0] * 40):
        matrix = turn @ np.diag(spread) @ turn.T
        values, vectors = jacobi_davidson.largest_eigenpairs(lambda block: matrix @ block, 40, 6)
        np.testing.assert_allclose(values, np.sort(spread)[::-1][:6], atol=1e-12)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
        np.testing.assert_allclose(matrix @ vectors, vectors * values, atol=1e-11)


def test_eigenpairs_of_a_large_operator_restart():
    rng = np.random.default_rng(9)
    data = rng.standard_normal((900, 300)) * np.linspace(0.5, 3, 300)
    matrix = data.T @ data / 900
    widths = []

    def product(block):
        widths.append(block.shape[1])
        return matrix @ block

    values, vectors = jacobi_davidson.largest_eigenpairs(product, 300, 8)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(matrix)[::-1][:8], rtol=1e-12)
    assert max(widths) <= 48


def plain_whitening(rows, size, components=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(t) for t in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    found = {}
    for i, x in kept:
        place = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        found[i] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), place)
    return found, values / np.trace(covariance), len(kept)


@pytest.mark.parametrize("size", [64, 20, 5])
def test_whitening(spark, size):
    rows = odd_vectors(120, size, 4)
    expected_rows, shares, kept = plain_whitening(rows, size)
    found = whitening.whitening_report(vector_table(spark, rows)).collect()
    width = min(size, 16)
    assert len(found) == kept * width
    signs = {}
    for r in found:
        n, deviation, place = expected_rows[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-10
        assert math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-10)
        value = place[r.component - 1]
        sign = signs.setdefault(r.component, math.copysign(1, value * r.whitened))
        assert math.isclose(r.whitened, sign * value, abs_tol=1e-8)


def test_whitening_of_flat_and_mixed_vectors(spark):
    same = whitening.whitening_report(vector_table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(same) == 4
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, 0.0) for r in same)
    # A constant entry has a component without variance; vectors of another length are on their own.
    rows = [(i, [float(i % 3), float(i % 2), 7.0]) for i in range(6)] + [(10, [1.0]), (11, [3.0])]
    found = whitening.whiten(vector_table(spark, rows))
    by_id = {r.kept_columns.vec_id: r for r in found.collect()}
    assert by_id[0].kept_columns.n == 2 and len(by_id) == 8
    assert all(r.whitened[2] is None and abs(r.explained[2]) < 1e-12 for i, r in by_id.items() if i < 6)
    assert sorted(round(by_id[i].whitened[0], 9) for i in (10, 11)) == [-1.0, 1.0] and by_id[10].n == 2
    assert whitening.whitening_report(vector_table(spark, rows).limit(0)).count() == 0
