"""Families of texts that share a template, and nodes that own a large share of all edges."""

from __future__ import annotations

import random

from coldledger.llm import near_dedup
from coldledger.llm.components import connected_components


def fresh(rng, count):
    return [f"w{rng.randrange(10**9)}" for _ in range(count)]


def brute_groups(texts):
    """Smallest number of each text's group, and the shingle sets."""
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group


def template_texts(rng, count):
    """``count`` texts with a similarity of 0.75, and near copies of every tenth of them."""
    template = fresh(rng, 300)
    texts = [" ".join(template + fresh(rng, 50)) for _ in range(count)]
    return texts + [text.rsplit(" ", 1)[0] for text in texts[::10]]


def test_large_families_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_TEXTS", 4)
    rng = random.Random(3)
    template = fresh(rng, 300)
    # Similarities on both sides of the threshold, of texts of like and unlike sizes.
    texts = [" ".join(template + fresh(rng, rng.randint(20, 80))) for _ in range(60)]
    texts += [t + " more words" for t in texts[::7]] + [" ".join(t.split()[40:]) for t in texts[::9]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_dedup.near_groups(docs, words=2, leader_rounds=0).collect()
    assert [g for _, g in sorted((r.doc_id, r.component_id) for r in found)] == brute_groups(texts)


def test_a_template_alone_brings_no_texts_together(spark):
    texts = template_texts(random.Random(4), 300)
    rows = [(i, i, 0, text) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "id long, component long, family long, text string")
    left = near_dedup._narrowed(table.drop("text"), table.select("id", "text"), 2, 80).collect()
    families = {}
    for row in left:
        families.setdefault(row.family, set()).add(row.id)
    assert {frozenset(f) for f in families.values()} == {frozenset((10 * k, 300 + k)) for k in range(30)}


def test_components_of_hot_nodes(spark):
    hub = [(0, i) for i in range(1, 4_001)] + [(i, 9_999) for i in range(2_000, 6_000)]
    other = [(20_000 + i, 30_000) for i in range(2_000)] + [(40_001, 40_000)]
    edges = spark.createDataFrame(hub + other, "u long, v long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    expected = {i: 0 for i in range(1, 6_000)} | {9_999: 0, 30_000: 20_000, 40_001: 40_000}
    assert found == expected | {i: 20_000 for i in range(20_001, 22_000)}
