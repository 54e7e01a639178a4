"""Odd tags, repeated ids and clashing columns."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from coldledger.llm import embedding_dedup, extraction, near_dedup
from coldledger.llm.blocks import leaf_blocks


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>A</p><p data=it's>Main text's end</p><p>C</p>", ["A", "Main text's end", "C"]),
        ('<div class="a"">It is "quoted" here</div>', ['It is "quoted" here']),
        ("<p>A</p><!--><p>B</p><!---><p>C</p><!-- x --!><p>D</p><!-- - -->E", ["A", "B", "C", "D", "E"]),
        ('<p class="open>text</p><p>more</p>', ["text", "more"]),
        ("<p title = 'a>b' id=c>ok</p><a href=a\"b>T</a>", ["ok", "T"]),
        ('<p a="b"c="d>e">z</p>', ["z"]),
        ("<p>A</p><!-- never closed <p>B</p>", ["A"]),
    ],
)
def test_quotes_and_comments(page, texts):
    assert [block.text for block in leaf_blocks(page)] == texts


def test_long_repeated_and_no_pages(spark):
    sentence = "The harbour was quiet that morning, and the boats came back one by one. "
    article = "".join(f"<p>{sentence * 4}</p>" for _ in range(9_000))
    long = f"<html><body><article>{article}</article></body></html>"
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, None, None)], "page_id long, url string, html string")
    rows = extraction.extract_text(pages).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows]
    whole = "\n".join([(sentence * 4).strip()] * 9_000)
    assert sorted((r.page_id, r.text) for r in rows) == [(1, whole), (1, whole), (2, "")]
    assert extraction.extract_text(pages.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(1)
    x, y = (" ".join(f"{letter}{rng.randrange(10**6)}" for _ in range(60)) for letter in "xy")
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    texts = [(5, x), (5, y), (7, x + " a"), (8, y + " b"), (8, y + " b"), (2, None), (None, x), (11, long), (12, long + " z")]
    docs = spark.createDataFrame([(*t, 1, "m") for t in texts], "doc_id long, text string, id int, mark string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(docs, words=2).collect()), key=str)
    expected = [(5, 5, True)] * 2 + [(7, 5, False)] + [(8, 5, False)] * 2 + [(2, 2, True), (None, None, True)]
    assert found == sorted(expected + [(11, 11, True), (12, 11, False)], key=str)
    vectors = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (8, [0.01, 1.0]), (9, None)]
    table = spark.createDataFrame([(*v, 1, "c") for v in vectors], "vec_id long, embedding array<float>, id int, copies string")
    links = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect())
    assert links == [(5, 1, 5), (5, 1, 5), (7, 1, 5), (8, 1, 5), (9, 0, 9)]
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_encoding_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 7, "x", 3)], "doc_id long, text string, n_tokens int, ids string, IDS_SHA256 int")
    row = corpus_pipeline.encode(spark, docs, "").first()
    assert (row["n_tokens"], row["ids"], row["IDS_SHA256"]) == (7, "x", 3)
    assert row["n_tokens_"] == 2 and len(row["ids_"]) == 4 and len(row["ids_sha256_"]) == 64
