"""Mixes against a replay in plain Python, and with more sources than one node of the tree holds."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coldledger.llm import mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _replayed(mix):
    """Words taken of each document, slot by slot."""
    size = mix.block_words
    blocks = {}
    for doc in mix.documents.collect():
        for word in range(doc["first_word"], doc["first_word"] + doc["size"]):
            blocks.setdefault((doc["source_no"], word // size), {})[word % size] = doc["doc_id"]
    taken = Counter()
    for slot in mix.slots.collect():
        for word in range(slot["words"]):
            taken[blocks[slot["source_no"], slot["block"]][word]] += 1
    return taken


@pytest.mark.parametrize("fanout", [2, 256])
def test_taken_words_are_those_of_the_slots(spark, monkeypatch, fanout):
    monkeypatch.setattr(mixing, "FANOUT", fanout)
    rng = np.random.default_rng(3)
    names = [None, "", "a", "b", "é", "😀", "z"]
    rows = [(i, "w " * int(rng.integers(0, 60)), names[min(int(rng.zipf(1.5)) - 1, 6)]) for i in range(400)]
    docs = _docs(spark, rows + [(400, None, "c"), (401, " \t", "only blanks")])
    mix = mixing.plan_mix(docs, block_words=7)
    report = {r["doc_id"]: r for r in mixing.mix_report(docs, block_words=7).collect()}
    replayed = _replayed(mix)
    assert {doc_id: r["taken"] for doc_id, r in report.items()} == {doc_id: replayed[doc_id] for doc_id in report}

    slots = [(r["source_no"], r["slot"]) for r in mix.slots.collect()]
    assert len(slots) == len(set(slots))
    shards = Counter(r["shard"] for r in mix.slots.collect())
    assert all(shards[i] == mixing.LEAST_SHARD_SLOTS for i in range(len(shards) - 1))

    sizes = Counter()
    for r in mix.documents.collect():
        sizes[r["source_no"]] += r["size"]
    wanted = mixing.target_words([sizes[i] for i in range(len(sizes))], [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    found = {r["source_no"]: r["target"] for r in mix.documents.collect()}
    assert [found[i] for i in range(len(sizes))] == pytest.approx(wanted)
    order = sorted({r[2] for r in rows} | {"c", "only blanks"}, key=lambda n: (n is None, n or ""))
    of_document = {r[0]: order.index(r[2]) for r in rows}
    assert all(r["source_no"] == of_document[r["doc_id"]] for r in mix.documents.collect() if r["doc_id"] < 400)


def test_targets_of_many_rounds(spark):
    sizes = [0, 10**9] + [3**i for i in range(18)] + [7] * 30
    frame = spark.createDataFrame(list(enumerate(sizes)), "source_no long, size long")
    found = [r["target"] for r in mixing.with_targets(frame, (5, 2, 1)).orderBy("source_no").collect()]
    assert found == pytest.approx(mixing.target_words(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))]))


def test_counts_meet_both_sides():
    drawn = mixing.split_counts([4, 0, 9, 2], [1, 0, 11, 3], [(1, i) for i in range(4)])
    assert drawn.sum(axis=0).tolist() == [1, 0, 11, 3] and drawn.sum(axis=1).tolist() == [4, 0, 9, 2]


def test_more_sources_than_two_levels_hold(spark):
    many = 150_000
    docs = spark.range(many).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("word "), (F.col("id") % 5).cast("int")).alias("text"),
        F.format_string("source %09d", "id").alias("source"),
    )
    rows = mixing.mix_report(docs).toPandas().sort_values("doc_id")
    assert rows["doc_id"].tolist() == list(range(many))
    sizes = [i % 5 for i in range(many)]
    wanted = mixing.target_words(sizes, [(5, 2, 1)[i % 3] for i in range(many)])
    assert rows["target"].tolist() == pytest.approx(wanted)
    assert rows["taken"].tolist() == [round(target) for target in wanted]
