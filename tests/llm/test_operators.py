"""The operators on small tables with odd rows, against plain Python."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pytest

from coldledger.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    extraction,
    mixing,
    near_dedup,
    quality,
    token_store,
    toxicity,
    warc,
)
from coldledger.llm.blocks import leaf_blocks
from coldledger.llm.chunking import chunk_ends
from coldledger.llm.components import connected_components
from coldledger.llm.training_pages import labelled_pages
from coldledger.llm.vocabularies import Encoder, public_path

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "Same text here",
    "same TEXT here",
    "same text here",
    LONG,
    LONG.upper(),
    LONG + " end",
    "Ärger naïve <|endoftext|> don't  stop now 日本語 ́x",
]
SCHEMA = "doc_id long, text string, lang string, source string, `row` string, `_row` int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, ["b", "a", None][i % 3], "r", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (6, TEXTS[6], "en", "b", "r", 1)], SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_chunks_cover_texts_and_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 50_000).astype(np.uint8)
    ends, _ = chunk_ends(text, np.array([0, len(text)]), 8, 2000)
    moved, owners = chunk_ends(np.concatenate([text[:777], text]), np.array([0, 777, 777 + len(text)]), 8, 2000)
    assert (moved[owners == 1] - 777 == ends).all() and ends[-1] == len(text)
    assert np.diff(ends).max() <= 2003


@pytest.mark.parametrize("digest_bytes", [1, 16])
def test_exact_dedup(docs, digest_bytes):
    rows = exact_dedup.exact_groups(docs, digest_bytes=digest_bytes, chunk_bits=6).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(fold(r.text), []).append(r.doc_id)
    assert len(rows) == 12
    for r in rows:
        ids = groups[next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)]
        assert (r.keep_id, r.group_size) == (max(ids), len(ids))
    # One of the two rows with the largest id stays.
    assert sum(r.kept for r in rows) == len(groups)


def test_exact_dedup_keeps_columns(docs, no_docs):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({fold(t) for t in TEXTS})
    assert {fold(r.text) for r in kept.collect()} == {fold(t) for t in TEXTS}
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_bpe_against_the_library(docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    found = bpe.encode_documents(docs.select("doc_id", "text"), chunk_bits=6).collect()
    assert len(found) == 12
    for r in found:
        text = TEXTS[r.kept_columns.doc_id] or ""
        ids = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u2").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoding_report(no_docs).count() == 0


def test_joined_pieces_agree_with_the_whole():
    made = Encoder(open(public_path("byte_bpe_50k.json")).read())
    finisher = bpe._Finisher(made)
    rng = np.random.default_rng(2)
    letters = ["a", " ", "  ", "\n", "é", "'ll", "'s", "<|endoftext|>", "…", "　", "日", "word", "12", "\x1f"]
    for _ in range(300):
        text = "".join(rng.choice(letters, rng.integers(1, 40)))
        cuts = sorted(set(rng.integers(0, len(text) + 1, 3).tolist()) | {0, len(text)})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        pieces = [np.frombuffer(ids, made.dtype) for ids in made.encode(parts)]
        assert bpe.joined_ids(pieces, finisher) == made.encode([text])[0]


def test_token_store_round_trip(docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = sorted(token_store.stored_tokens(docs, with_ids=True).collect())
    start = 0
    for r in rows:
        ids = plain.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.ids == ids and (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(rows) == 12 and token_store.stored_tokens(no_docs).count() == 0


@pytest.mark.parametrize(("size", "used"), [(1, 1), (5, 3), (513, 2), (1024, 9), (20_000, 5000)])
def test_huffman_round_trip(size, used):
    ids = np.minimum(np.random.default_rng(size).zipf(1.2, size) - 1, used - 1).astype(np.uint32)
    lengths = token_store.code_lengths(np.bincount(ids, minlength=used))
    assert lengths.max() <= 16
    packed, checks = token_store.pack(ids, token_store.canonical_codes(lengths), lengths)
    assert (token_store.unpack(packed, checks, size, token_store.decoding_table(lengths)) == ids).all()


def test_mix_reaches_targets(docs, no_docs):
    rows = mixing.mix_report(docs, block_words=7).collect()
    assert len(rows) == 12 and all(r.taken <= 3 * r.size for r in rows)
    for target in {r.target for r in rows}:
        assert abs(sum(r.taken for r in rows if r.target == target) - target) < 1
    mixed = mixing.mix_documents(docs, block_words=7)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect())
    assert mixed.columns == docs.columns and words == sum(r.taken for r in rows)
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 100, 1025])
def test_permutation(size):
    made = mixing.Permutation(size, 9)
    values = made.at(np.arange(size))
    assert sorted(values) == list(range(size)) and all(made.place_of(int(v)) == i for i, v in enumerate(values))


def test_target_words_stop_at_three_times_the_size():
    assert mixing.target_words([10, 0, 1000], [5, 2, 1]) == [30.0, 0.0, 980.0]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (7, 7), (98, 99)], "u long, v long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {99: 98}


def test_near_dedup(spark, no_docs):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in rng.integers(0, 10**6, 300)]
    texts = [None, "", "One", "one", " \n"]
    for k in range(60):
        words = list(base)
        for place in rng.choice(300, k % 20, replace=False):
            words[place] = f"e{k}_{place}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component int")
    sets = {}
    for i, t in enumerate(texts):
        w = fold(t).split()
        sets[i] = set(zip(w, w[1:])) if len(w) > 1 else set(w)
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
                if union and 100 * both >= 80 * union and component[a] != component[b]:
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    for rounds in (0, 2):
        rows = near_dedup.near_groups(docs, words=2, leader_rounds=rounds).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {
            i: (len(sets[i]), c, i == c) for i, c in component.items()
        }
    assert near_dedup.near_dedup(docs.union(docs), words=2).count() == len(set(component.values())) + 3
    assert near_dedup.near_dedup(no_docs).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(60, 20))
    vectors[30:50] = vectors[:20] + 0.3 * rng.normal(size=(20, 20))
    vectors[50:] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(60, None), (61, [0.0] * 20), (62, [None] * 20), (63, [float("nan")] * 20), (64, []), (65, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = units @ units.T >= 0.9
    label = np.arange(60)
    for _ in range(60):
        label = np.array([label[row].min() for row in linked])
    expected = {i: (int(linked[i].sum()) - 1, int(label[i]), i == label[i]) for i in range(60)}
    expected |= {i: (0, i, True) for i in range(60, 66)}
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == expected
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a", long), (2, None, long), (3, "http://c\r\nX: y", "short"), (4, "u", "short"), (5, "u", None)]
    rows += [(None, "n", long), (7, "b", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_warc(warc.with_record_types(pages), str(tmp_path / "w"), archive_bytes=300)
    found = {r.page_id: r for r in warc.read_warc(index, str(tmp_path / "w")).collect()}
    assert len(found) == 7
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        1: ("revisit", 2), None: ("revisit", 2), 2: ("response", None), 3: ("response", None),
        4: ("response", None), 5: ("response", None), 7: ("response", None),
    }
    for i, _, text in rows:
        payload = (text or "").encode()
        assert found[i].payload_bytes == len(payload)
        assert found[i].payload_digest == hashlib.sha1(payload).hexdigest()
    one = warc.read_warc(index.where("page_id = 7"), str(tmp_path / "w")).collect()
    assert [bytes(r.payload) for r in one] == [b"x" * 5000]
    assert warc.archived(pages.limit(0)).count() == 0


def test_extraction_on_pages_of_other_seeds():
    field = extraction.trained_field()
    wrong = total = 0
    for page, known in labelled_pages(100, 99):
        blocks, labels = extraction.matched_labels(page, known)
        wrong += sum(a != b for a, b in zip(labels, field.labels(blocks)))
        total += len(labels)
    assert wrong < 0.03 * total


def test_words_of_a_small_language_are_mined(spark):
    """One language has far more toxic texts, and many more telling words."""
    rows = [(1, f"gromble{'abcdefgh'[i % 8]} snarfly fooey{i % 60} some talk") for i in range(160)]
    rows += [(1, f"bocoox palabra{i} dicha") for i in range(7)] + [(0, f"plain talk dicha {i}") for i in range(900)]
    labelled = spark.createDataFrame(rows, "label int, text string").repartition(3)
    mined = toxicity.mined_words(labelled)
    assert any("bocoox".startswith(word.rstrip("*")) for word in mined)
    assert any("grombleabcdefgh".startswith(word.rstrip("*")) for word in mined)
    assert not {"plain", "talk", "dicha", "plai*"} & set(mined) and mined == toxicity.mined_words(labelled.coalesce(1))
    assert toxicity.mined_words(labelled, 1) == mined[:1]


@pytest.mark.parametrize(
    "script",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<SCRIPT>a<b</Script >",
        "<script><!-- f()</script>",
        "<script><!--> f(); <!-- <script>g()</script> --></script>",
        "<script>if(a<b){s=\"it's\"}</script>",
        "<script>s='<x y=\"'</script>",
        "<style>a:after{content:'<b \"'}</style>",
        "<style><!-- p{margin:0}</style>",
        "<script>s='</scripts>'</script>",
    ],
)
def test_text_after_scripts_and_styles(script):
    page = f"<p>A</p>{script}<p>Main text</p><script>last<one</script><p>End</p>"
    assert [block.text for block in leaf_blocks(page)] == ["A", "Main text", "End"]


@pytest.mark.parametrize(
    "markup, texts",
    [
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is</p>", ["If x=1 is"]),
        ("<p>A <svg><g><path d=''/></g><svg><text>T</text></svg></svg> B</p><p>C</p>", ["A T B", "C"]),
        ("<p>A <svg><path/> B</p><p>C</p>", ["A B", "C"]),
        ("<div>A <svg><g><div>B</div></div><p>C</p>", ["A", "B", "C"]),
        ("<p>A <noscript><img src=x></noscript> B</p>", ["A B"]),
        ("<p>A <noscript>F <b>G</b></noscript> B</p>", ["A", "F G", "B"]),
        ("<div>A<object><p>F</p><object>G</object></object></div><p>C</p>", ["A", "F", "G", "C"]),
        ("<div>A<iframe src=x>F</div><p>C</p>", ["A", "F", "C"]),
        ("<p>A <template><template>T</template>U<script>'</template>'</script>V</template> B</p>", ["A B"]),
    ],
)
def test_content_of_formulas_and_fallbacks(markup, texts):
    assert [block.text for block in leaf_blocks(markup)] == texts


def test_extraction_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "u", ""), (-3, "u", "<p")], "page_id long, url string, html string")
    found = {r.page_id: r for r in extraction.extract_text(pages.unionByName(odd)).collect()}
    assert [found[i].text for i in (-1, -2)] == ["", ""]
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1).replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?p>|</?h1>", article)]
        text = "\n".join(p for p in parts if p)
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (text, len(text))


def test_classifiers_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for report, column, least in (
        (quality.quality_report, "quality", 0.98),
        (toxicity.toxicity_report, "toxic", 0.95),
    ):
        rows = report(docs, labels).join(labels, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r[column] for r in rows) >= least * len(rows)


def test_classifiers_on_odd_texts(docs, no_docs, spark):
    labels = spark.createDataFrame([(4, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    for report in (quality.quality_report, toxicity.toxicity_report):
        rows = report(docs, labels).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert report(no_docs, labels).count() == 0
        assert report(docs, labels.limit(0)).count() == 12
