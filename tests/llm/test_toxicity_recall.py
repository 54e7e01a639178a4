"""Held-out recall of toxic texts, and what the label model makes of wrong labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from coldledger.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_recall_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    report = toxicity.toxicity_report(docs, labels).where("held_out").select("doc_id", "predicted")
    known = report.join(labels.where("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    found = {r.toxic: (r.rows, r.flagged) for r in known.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum("predicted").alias("flagged")).collect()}
    toxic, caught = found[1]
    clean, flagged = found[0]
    assert toxic >= 50 and caught >= 0.9 * toxic
    assert flagged <= 0.01 * clean


def test_labels_are_a_voter_of_estimated_accuracy():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.2
    votes = np.where(truth[:, None], rng.random((4000, 8)) < 0.6, rng.random((4000, 8)) < 0.03).astype(float)
    wrong = rng.random(4000) < 0.1
    model, given = toxicity.fit_label_model(votes, truth ^ wrong)
    # A label counts what its agreement with the voters says: about log(0.9 / 0.1).
    assert 1.5 < given.max() < 3 and -3 < given.min() < -1.5
    posterior = model.posterior(votes, given)
    assert ((posterior >= 0.5) == truth).mean() > 0.97
    assert ((posterior >= 0.5)[wrong] == truth[wrong]).mean() > 0.9
