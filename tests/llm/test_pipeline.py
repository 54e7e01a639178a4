"""Every stage of the corpus pipeline against plain Python, each on what its predecessor wrote."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from coldledger.llm import mixing, near_dedup, quality
from coldledger.llm.vocabularies import public_path
from coldledger.session import shared_folder

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda found: found.group().lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and what each stage made of them."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(number))
        stage(spark, made[-1], SF).write.parquet(path)
        made.append(spark.read.parquet(path))
    return made


def test_columns(stages):
    assert all(made.columns == stages[0].columns for made in stages[:-1])


def test_quality_keeps_what_it_accepts(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    predicted = {r.doc_id for r in quality.quality_report(stages[0], labels).collect() if r.predicted}
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(predicted)


def test_exact_copies_go(stages):
    best = {}
    for row in stages[1].collect():
        key = fold(row.text)
        best[key] = max(best.get(key, row.doc_id), row.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(best.values())


def test_one_of_each_near_group_stays(stages):
    sets = {}
    for row in stages[2].collect():
        words = words_of(fold(row.text))
        size = near_dedup.WORDS
        sets[row.doc_id] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    owners = defaultdict(list)
    for doc_id, shingles in sets.items():
        for shingle in shingles:
            owners[shingle].append(doc_id)
    root = {doc_id: doc_id for doc_id in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, shingles in sets.items():
        for b, both in Counter(b for shingle in shingles for b in owners[shingle] if b > a).items():
            if 100 * both >= near_dedup.LEAST_PERCENT * (len(shingles) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    kept = [row.doc_id for row in stages[3].collect()]
    assert sorted(find(doc_id) for doc_id in kept) == sorted({find(doc_id) for doc_id in sets})


def test_mix_takes_the_targets(stages):
    before = {row.doc_id: row for row in stages[3].collect()}
    sizes, taken, of_document = Counter(), Counter(), Counter()
    for row in before.values():
        sizes[row.source] += len(words_of(row.text))
    for row in stages[4].collect():
        words = words_of(row.text)
        assert row.source == before[row.doc_id].source and words
        whole = Counter(words_of(before[row.doc_id].text))
        assert not Counter(words) - whole
        of_document[row.doc_id] += len(words)
        taken[row.source] += len(words)
    assert all(count <= 3 * len(words_of(before[doc_id].text)) for doc_id, count in of_document.items())
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weights = [mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i in range(len(names))]
    for name, target in zip(names, mixing.target_words([sizes[name] for name in names], weights)):
        # Blocks are drawn at random; a shard's slots bound how far off a source may end.
        assert abs(taken[name] - target) <= 0.1 * sum(sizes.values())


def test_ids_are_those_of_the_library(stages):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    before = Counter((row.doc_id, row.text) for row in stages[4].collect())
    wanted = Counter()
    for (doc_id, text), count in before.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        listed = ",".join(map(str, ids))
        wanted[
            (doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        ] += count
    rows = stages[5].collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == wanted
    for row in rows[:50]:
        width = len(row.ids) // row.n_tokens if row.n_tokens else 4
        listed = ",".join(map(str, np.frombuffer(bytes(row.ids), f"<u{width}").tolist()))
        assert hashlib.sha256(listed.encode()).hexdigest() == row.ids_sha256


def test_run_leaves_only_its_result(spark):
    folder = shared_folder(spark)
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert rows.count() > 0 and len(left) == 1 and rows.inputFiles()[0].split("/")[-2] in left


def test_staged_tables_stay_while_the_next_stage_reads_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unwritten = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    again = corpus_pipeline.drop_exact_copies(spark, unwritten, SF)
    assert again.count() == unwritten.count() > 0


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id IS NULL"), SF).count() == 0
