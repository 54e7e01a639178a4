"""Benchmark passages in a corpus, found in a positional inverted index; DataFrame operations only.

The index has one posting per word of each document: word, document, position. It is split by
documents, and each part is sorted by word, so building it moves nothing between tasks. A phrase is
looked up from its rarest words on: the list of the rarest word, less the word's place in the item,
gives the places where the item could begin; these are intersected with the list of the next rarest,
and the few that remain with the lists of all other words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

WINDOW = 10
#: Fixed value: what a word is, after A-Z were lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The posting of this word, which no text has, is a document's end: its position is the number of words.
_END = ""


def words_of(text: Column) -> Column:
    """All words of a text in order, A-Z lower-cased; none for null."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``term`` (hash of the word), ``word``, ``row``, ``pos`` of all words of all texts, staged.

    ``row`` numbers the rows of ``docs``, so repeated and null ids do no harm; the posting of the empty
    word has a document's ``doc_id`` and, as ``pos``, its number of words. Null and empty texts have
    only that one.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{doc_id}`"].alias("doc_id"),
        F.concat(words_of(docs[f"`{text}`"]), F.array(F.lit(_END))).alias("words"),
    )
    postings = numbered.select("row", "doc_id", F.posexplode("words").alias("pos", "word"))
    return durable(
        postings.select(
            F.xxhash64("word").alias("term"),
            "word",
            "row",
            "pos",
            F.when(F.col("word") == _END, F.col("doc_id")).alias("doc_id"),
        ).sortWithinPartitions("term")
    )


def indexed_documents(index: DataFrame) -> DataFrame:
    """``row``, ``doc_id`` and ``n_words`` of each document."""
    ends = index.where((F.col("term") == F.xxhash64(F.lit(_END))) & (F.col("word") == _END))
    return ends.select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def numbered_items(items: DataFrame, text: str = "text") -> DataFrame:
    """``item`` (a number) and ``words`` of each different sequence of words, staged; items without words have none."""
    found = items.select(words_of(items[f"`{text}`"]).alias("words")).where(F.size("words") > 0).distinct()
    return durable(found.select(F.monotonically_increasing_id().alias("item"), "words"))


def places_of(items: DataFrame, index: DataFrame) -> DataFrame:
    """``item``, ``length``, ``place``, ``word`` of each word of each item, and how many ``postings`` the index has for it, staged."""
    places = items.select("item", F.size("words").alias("length"), F.posexplode("words").alias("place", "word"))
    wanted = durable(places.select("word").distinct())
    counts = index.join(wanted, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("postings"))
    return durable(places.join(counts, "word", "left").withColumn("postings", F.coalesce("postings", F.lit(0))))


def _windows(places: DataFrame, window: int) -> DataFrame:
    """Windows all of whose words are in the index: ``item``, ``start``, ``size`` and the places and words
    of the rarest (p1, w1) and the next rarest (p2, w2, null for a single word)."""
    frame = Window.partitionBy("item").orderBy("place").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_list(F.struct("postings", "place", "word")).over(frame))
    size = F.least("length", F.lit(window))
    second = F.when(F.size("ranked") > 1, F.get("ranked", F.lit(1)))
    return durable(
        places.select("item", F.col("place").alias("start"), size.alias("size"), "length", ranked.alias("ranked"))
        .where((F.col("start") + F.col("size") <= F.col("length")) & (F.col("ranked")[0]["postings"] > 0))
        .select(
            "item",
            "start",
            "size",
            F.col("ranked")[0]["place"].alias("p1"),
            F.col("ranked")[0]["word"].alias("w1"),
            second["place"].alias("p2"),
            second["word"].alias("w2"),
        )
    )


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches: ``row``, ``start`` and ``words`` of each longest run of words that a document has in common
    with ``item`` from its place ``item_start`` on, if the run has ``window`` words or all words of the item. Staged.

    ``items`` are those of ``numbered_items``. What is joined with the index is as large as the lists of the
    rarest words; no document and no pair of document and item is looked at that has none in common.
    """
    places = places_of(items, index)
    windows = _windows(places, window)
    postings = index.select("word", "row", "pos")

    seeds = windows.select("item", "p1", F.col("w1").alias("word")).distinct()
    first = postings.join(seeds, "word").select("item", "row", "p1", (F.col("pos") - F.col("p1")).alias("shift"))

    several = windows.where(F.col("p2").isNotNull())
    pairs = durable(several.select("item", "p1", "p2", F.col("w2").alias("word")).distinct())
    asked = first.join(pairs, ["item", "p1"]).withColumn("pos", F.col("shift") + F.col("p2")).where("pos >= 0")
    second_lists = postings.join(pairs.select("word").distinct(), "word", "left_semi")
    agreed = asked.join(second_lists, ["row", "pos", "word"]).select("item", "row", "shift", "p1", "p2")
    span = ["item", "row", "shift", "start", "size"]
    single = windows.where(F.col("p2").isNull()).select("item", "p1", "start", "size")
    likely = durable(
        agreed.join(several.select("item", "p1", "p2", "start", "size"), ["item", "p1", "p2"])
        .select(*span)
        .unionByName(first.join(single, ["item", "p1"]).select(*span))
    )

    last = F.col("start") + F.col("size") - 1
    rest = (
        likely.select("item", "row", "shift", F.explode(F.sequence("start", last)).alias("place"))
        .distinct()
        .join(places.select("item", "length", "place", "word"), ["item", "place"])
        .withColumn("pos", F.col("shift") + F.col("place"))
    )
    lists = postings.join(durable(likely.select("row").distinct()), "row", "left_semi")
    present = rest.join(lists, ["row", "pos", "word"])
    diagonal = Window.partitionBy("item", "row", "shift").orderBy("place")
    runs = (
        present.withColumn("run", F.col("place") - F.row_number().over(diagonal))
        .groupBy("item", "row", "shift", "run")
        .agg(F.min("place").alias("item_start"), F.count(F.lit(1)).alias("words"), F.max("length").alias("length"))
        .where(F.col("words") >= F.least("length", F.lit(window)))
    )
    return durable(
        runs.select("row", "item", (F.col("shift") + F.col("item_start")).alias("start"), "words", "item_start")
    )


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """``row``, ``item`` and ``pos`` of each occurrence of an item's rarest word that has all the item's other
    words at most ``within`` words before or after it, in any order."""
    places = places_of(items, index)
    words = durable(places.groupBy("item", "word").agg(F.first("postings").alias("postings")))
    rank = Window.partitionBy("item").orderBy("postings", "word")
    ranked = durable(
        words.select(
            "item", "word", F.row_number().over(rank).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("item")).alias("needed")
        )
    )
    postings = index.select("word", "row", "pos")
    anchors = postings.join(ranked.where("rank = 1").select("item", "word", "needed"), "word").select(
        "item", "row", F.col("pos").alias("anchor"), "needed"
    )
    block = F.floor(F.col("anchor") / within)
    asked = anchors.join(ranked.where("rank > 1").select("item", "word"), "item").withColumn(
        "block", F.explode(F.sequence(block - 1, block + 1))
    )
    lists = postings.join(ranked.select("word").distinct(), "word", "left_semi").withColumn(
        "block", F.floor(F.col("pos") / within)
    )
    near = (
        asked.join(lists, ["row", "word", "block"])
        .where(F.abs(F.col("pos") - F.col("anchor")) <= within)
        .groupBy("item", "row", "anchor", "needed")
        .agg(F.count_distinct("word").alias("found"))
        .where(F.col("found") == F.col("needed") - 1)
    )
    alone = anchors.where("needed = 1")
    matches = near.select("row", "item", F.col("anchor").alias("pos"))
    return matches.unionByName(alone.select("row", "item", F.col("anchor").alias("pos")))


def _hit_words(matches: DataFrame) -> DataFrame:
    """``row`` and ``n_hit``: words inside any of its matches, each counted once."""
    earlier = Window.partitionBy("row").orderBy("start", "words").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("words")
    before = F.coalesce(F.max(end).over(earlier), F.lit(0))
    new = F.greatest(end - F.greatest("start", before), F.lit(0))
    spans = matches.select("row", "start", "words").distinct()
    return spans.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``.

    A null text has no words, and an item without words no windows. Rows of ``docs`` that share an id are
    reported one by one. Items that share an id count as one in ``n_items``; an item whose id is null hits
    words but has no id to be counted or listed. Without matching items the hash is that of the empty
    text. An empty table of documents gives an empty result, an empty benchmark hits nothing. Texts of any
    length are taken whole; further columns do not matter, whatever their names.
    """
    index = build_index(docs, doc_id, text)
    named = durable(
        benchmark.select(
            words_of(benchmark[f"`{text}`"]).alias("words"), benchmark[f"`{item_id}`"].cast("string").alias("item_id")
        ).distinct()
    )
    items = numbered_items(benchmark, text)
    members = durable(named.where("item_id IS NOT NULL").join(items, "words").select("item", "item_id"))
    matches = phrase_matches(index, items, window)
    listed = (
        matches.select("row", "item")
        .distinct()
        .join(members, "item")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    found = indexed_documents(index).join(_hit_words(matches), "row", "left").join(listed, "row", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
