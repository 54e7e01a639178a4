"""Toxicity by weak supervision.

Many voters look at a text: one for each word of a lexicon, stated or mined from labelled texts,
one for each mined word beginning, and some patterns. A generative model estimates how often each
voter fires on toxic and on clean texts, and which voters only repeat each other. The given label of
a training text is one more voter: what it counts is estimated from how it agrees with the others.
The model's posterior labels train a linear classifier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable, ship_package
from .arrays import batchwise, slices, texts_of
from .labelled import logistic, remainder, training_rows

#: Labelled documents to learn from, at most; it bounds what reaches the driver.
TRAINING_ROWS = 10_000
#: Lengths of word beginnings; they are written with a star.
BEGINNINGS = (4, 5, 6, 7)
#: Labels of ids whose remainder by DIVISOR is HELD_OUT are never learned from.
DIVISOR, HELD_OUT = 5, 0
RIDGE = 1e-4
#: How often a given label is taken to be right at first.
FIRST_TRUST = 0.9
#: Mined words are chosen until each toxic training text has so many, where there are any: the one of
#: these numbers that does best on the part of the training rows that is kept from its own choice of words.
VOTERS_OF_TEXT = (1, 2, 4, 8, 16)
_CHECKED_PART = 3
# Common English, German, French and Spanish insults.
LEXICON = (
    "asshole bastard bitch clown cretin disgusting dumb fool freak garbage idiot imbecile loser moron pathetic pig "
    "scum shit stupid trash ugly useless vermin worthless "
    "abschaum arschloch blödmann depp dummkopf idioten schlampe trottel versager "
    "abruti connard crétin débile imbécile ordure salaud "
    "basura cabrón escoria estúpido gilipollas idiota imbécil inútil"
).split()
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "curse": re.compile(r"\b(?:shut up|go to hell|drop dead|kill yourself|hate you|screw you)\b"),
    "named": re.compile(r"\byou(?:'re| are)? (?:such )?(?:an? )?(?:idiot|moron|loser|fool|clown|scum)"),
}
_DISGUISED = re.compile(r"[^\W\d_][0134578@$!]+[^\W\d_]")
_PLAIN_LETTERS = str.maketrans("0134578@$!", "oieastbasi")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .*-]){3,}[^\W\d_]\b")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hits(text: str, place: dict[str, int], count: int) -> np.ndarray:
    """How often each voter fires: lexicon words, then patterns, then disguised words."""
    fired = np.zeros(count + len(_PATTERNS) + 1)
    lower = text.lower()
    for word in _WORD.findall(lower):
        if word in place:
            fired[place[word]] += 1
        for size in BEGINNINGS:
            if len(word) > size and (begun := word[:size] + "*") in place:
                fired[place[begun]] += 1
    for k, pattern in enumerate(_PATTERNS.values()):
        if pattern.search(lower):
            fired[count + k] = len(pattern.findall(lower))
    hidden = []
    if _DISGUISED.search(lower):
        hidden += [w for w in _WORD.findall(lower.translate(_PLAIN_LETTERS)) if w in place]
        hidden += [f"-{w}" for w in _WORD.findall(lower) if w in place]
    disguised = max(0, len([w for w in hidden if w[0] != "-"]) - len([w for w in hidden if w[0] == "-"]))
    disguised += sum(re.sub(r"[ .*-]", "", found) in place for found in _SPACED.findall(lower))
    fired[-1] = disguised
    return fired


def _matrix(texts: list[str], lexicon: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Firings of all voters and the number of words of each text."""
    place = {word: k for k, word in enumerate(lexicon)}
    fired = np.array([_hits(text, place, len(lexicon)) for text in texts]).reshape(
        len(texts), len(lexicon) + len(_PATTERNS) + 1
    )
    return fired, np.array([text.count(" ") + 1 for text in texts], np.float64)


@dataclass(frozen=True)
class LabelModel:
    """How probable it is that a voter fires on toxic and on clean texts, how much it counts beside
    the voters it repeats, and the share of toxic texts."""

    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """``given``: the log odds that the given labels add."""
        fires = np.log(self.toxic / self.clean) * self.share
        quiet = np.log((1 - self.toxic) / (1 - self.clean)) * self.share
        odds = given + np.log(self.prior / (1 - self.prior)) + votes @ fires + (1 - votes) @ quiet
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _shares(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """One over the number of voters, itself included, that a voter repeats within a class: the sum
    of squared correlations left once the class is known."""
    rest = np.zeros((votes.shape[1], votes.shape[1]))
    for weight in (posterior, 1 - posterior):
        total = weight.sum()
        if total > 1:
            centred = (votes - (weight @ votes) / total) * np.sqrt(weight)[:, None]
            rest += centred.T @ centred
    spread = np.sqrt(np.maximum(np.diag(rest), 1e-12))
    related = (rest / np.outer(spread, spread)) ** 2
    np.fill_diagonal(related, 1.0)
    return 1 / np.maximum(related.sum(axis=1), 1.0)


def fit_label_model(votes: np.ndarray, known: np.ndarray, rounds: int = 30) -> tuple[LabelModel, np.ndarray]:
    """The model of 0/1 ``votes`` and the log odds that the given labels add, by expectation maximisation.

    ``known`` says which texts are labelled toxic; that starts the estimate, and so fixes which class
    is which. After that the labels are a voter whose rates are those at which the other voters see it
    fire on toxic and on clean texts.
    """
    toxic_rate, clean_rate = FIRST_TRUST, 1 - FIRST_TRUST
    posterior = np.where(known, toxic_rate, clean_rate)
    model, given = None, np.zeros(len(votes))
    for _ in range(rounds):
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        model = LabelModel(
            np.clip((posterior @ votes + 0.1) / (toxic + 1), 1e-4, 1 - 1e-4),
            np.clip(((1 - posterior) @ votes + 0.01) / (clean + 1), 1e-5, 1 - 1e-4),
            _shares(votes, posterior),
            float(np.clip((toxic + 1) / (len(votes) + 2), 1e-4, 0.5)),
        )
        others = model.posterior(votes, np.zeros(len(votes)))
        toxic_rate = (others @ known + 1) / (others.sum() + 2)
        clean_rate = ((1 - others) @ known + 1) / ((1 - others).sum() + 2)
        given = np.where(known, np.log(toxic_rate / clean_rate), np.log((1 - toxic_rate) / (1 - clean_rate)))
        after = model.posterior(votes, given)
        if np.abs(after - posterior).max() < 1e-6:
            break
        posterior = after
    return model, given


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[str, ...]
    weights: np.ndarray

    def odds(self, fired: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log odds of being toxic, from ``_matrix``."""
        return _inputs(fired, words) @ self.weights[:-1] + self.weights[-1]

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(*_matrix(texts, self.lexicon)), -500, 500)))


def _inputs(fired: np.ndarray, words: np.ndarray) -> np.ndarray:
    total = fired.sum(axis=1)
    return np.hstack([fired > 0, np.log1p(total)[:, None], (np.minimum(100 * total / words, 10))[:, None]]).astype(float)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words, labels, places = [], [], []
            columns = (batch.column(name).to_pylist() for name in ("label", "place"))
            for text, label, place in zip(texts_of(batch.column("text")), *columns):
                own = set(_words(text))
                own |= {word[:size] + "*" for word in own for size in BEGINNINGS if len(word) > size}
                words += own
                labels += [label] * len(own)
                places += [place if label else None] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(places, pa.int64())],
                ["word", "label", "place"],
            )


def covering_words(words: list[str], texts: list[np.ndarray], odds: np.ndarray, voters: int) -> list[str]:
    """``words`` chosen one by one by the ``texts`` they add, times their log odds.

    A text counts for a word while no chosen word is in it; when no word adds three such texts, while
    one chosen word is in it, and so on up to ``voters``. So a language's words do not compete with
    those of a larger one for the same texts. A word is left out if a chosen one covers it.
    """
    counts = np.array([len(own) for own in texts], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    flat, place = np.unique(np.concatenate([np.zeros(0, np.int64), *texts]), return_inverse=True)
    starts = np.cumsum(counts) - counts
    times, free = np.zeros(len(flat), np.int64), np.ones(len(words), bool)
    chosen: dict[str, int] = {}
    layer = 0
    while free.any() and layer < voters:
        added = np.bincount(owner, times[place] <= layer, len(words)) * free
        if added.max() < 3:
            layer += 1
            continue
        gain = np.where(added >= 3, added * odds, -np.inf)
        k = int(gain.argmax())
        word, count, free[k] = words[k], int(counts[k]), False
        stem = word.rstrip("*")
        covered = any(stem.startswith(old[:-1]) for old in chosen if old[-1] == "*")
        covered |= word[-1] == "*" and any(old.startswith(stem) and 5 * count < 6 * n for old, n in chosen.items())
        if not covered:
            chosen[word] = count
            times[place[starts[k] : starts[k] + count]] += 1
    return list(chosen)


def words_by_voters(rows: DataFrame, voters: Sequence[int]) -> list[list[str]]:
    """Words and beginnings of toxic training texts that clean ones have hardly ever, for each number of ``voters``."""
    toxic, clean = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not toxic or not clean:
        return [[] for _ in voters]
    counted = (
        rows.select("label", "text", F.monotonically_increasing_id().alias("place"))
        .transform(batchwise, _word_rows, "word string, label int, place bigint")
        .groupBy("word")
        .agg(
            F.sum("label").alias("toxic"),
            F.sum(1 - F.col("label")).alias("clean"),
            F.collect_list("place").alias("places"),
        )
        .where((F.col("toxic") >= 3) & (F.col("toxic") * clean > F.col("clean") * toxic * 20))
    )
    found = counted.select("word", "toxic", "clean", "places").toPandas().sort_values("word")
    odds = np.log((found["toxic"].to_numpy(float) + 0.5) / (found["clean"].to_numpy(float) + 0.5) * (clean / toxic))
    words, places = found["word"].tolist(), [np.asarray(own, np.int64) for own in found["places"]]
    return [covering_words(words, places, odds, number) for number in voters]


def mined_words(rows: DataFrame, most: int | None = None, voters: int = 2) -> list[str]:
    """The words for one number of ``voters``, the most telling first; all of them, or the first ``most``."""
    return words_by_voters(rows, [voters])[0][:most]


@dataclass(frozen=True)
class _Sample:
    """Firings (``counts``) of the voters of a lexicon, number of words and label of each training text."""

    lexicon: tuple[str, ...]
    counts: np.ndarray
    words: np.ndarray
    known: np.ndarray
    checked: np.ndarray

    def columns(self, lexicon: tuple[str, ...], rows: np.ndarray) -> _Sample:
        """That of a smaller lexicon and some rows."""
        kept = [k for k, word in enumerate(self.lexicon) if word in set(lexicon)]
        kept += range(len(self.lexicon), self.counts.shape[1])
        return _Sample(lexicon, self.counts[np.ix_(rows, kept)], self.words[rows], self.known[rows], self.checked[rows])


def _sample(rows: DataFrame, lexicon: tuple[str, ...]) -> _Sample:
    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                votes, words = _matrix(texts_of(batch.column("text")), lexicon)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label"),
                        batch.column("checked"),
                        pa.array(words),
                        pa.FixedSizeListArray.from_arrays(pa.array(votes.ravel()), votes.shape[1]).cast(
                            pa.list_(pa.float64())
                        ),
                    ],
                    ["label", "checked", "words", "fired"],
                )

    schema = "label int, checked boolean, words double, fired array<double>"
    found = rows.select("label", "checked", "text").transform(batchwise, fired, schema).toPandas()
    size = len(lexicon) + len(_PATTERNS) + 1
    found["key"] = [np.asarray(f, float).tobytes() for f in found["fired"]]
    found = found.sort_values(["key", "words", "label", "checked"])  # the order of tasks must not matter
    if not len(found):
        return _Sample(lexicon, np.zeros((1, size)), np.ones(1), np.zeros(1, bool), np.zeros(1, bool))
    return _Sample(
        lexicon,
        np.array([np.frombuffer(key) for key in found["key"]], float).reshape(len(found), size),
        found["words"].to_numpy(float),
        found["label"].to_numpy() == 1,
        found["checked"].to_numpy(bool),
    )


def _fitted(sample: _Sample) -> ToxicityModel:
    votes = (sample.counts > 0).astype(float)
    model, given = fit_label_model(votes, sample.known)
    posterior = model.posterior(votes, given)
    weights = logistic(_inputs(sample.counts, sample.words), posterior, RIDGE, intercept=True)
    # What was not seen to fire keeps the say of an average voter of the stated lexicon.
    size = votes.shape[1]
    seen = votes.any(axis=0)
    if seen.any() and not seen.all():
        weights[:size][~seen] = np.median(weights[:size][seen])
    elif not seen.any():
        weights[:size], weights[-1] = 4.0, -2.0
    return ToxicityModel(sample.lexicon, weights)


def _lexicon(mined: list[str]) -> tuple[str, ...]:
    return tuple(sorted(set(LEXICON) | set(mined)))


def best_voters(rows: DataFrame) -> int:
    """The number of voters a text that does best, by the harmonic mean of precision and recall, on the checked
    part of the training ``rows`` when words are mined from the rest; of equally good ones the smallest."""
    lexicons = [_lexicon(words) for words in words_by_voters(rows.where(~F.col("checked")), VOTERS_OF_TEXT)]
    sample = _sample(rows, tuple(sorted(set().union(*lexicons))))
    best, choice = -1.0, VOTERS_OF_TEXT[0]
    for voters, lexicon in zip(VOTERS_OF_TEXT, lexicons):
        model = _fitted(sample.columns(lexicon, np.flatnonzero(~sample.checked)))
        checked = sample.columns(lexicon, np.flatnonzero(sample.checked))
        toxic = model.odds(checked.counts, checked.words) >= 0
        score = 2 * (toxic & checked.known).sum() / max(1, toxic.sum() + checked.known.sum())
        if score > best:
            best, choice = score, voters
    return choice


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from a sample of at most TRAINING_ROWS labelled documents (doc_id, text).

    The sample is staged. All its words count; how many become voters is chosen within it.
    """
    ship_package(docs.sparkSession)
    part = F.pmod(F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string")).cast("binary")), F.lit(_CHECKED_PART))
    rows = durable(
        training_rows(docs, labels, "toxic", TRAINING_ROWS, DIVISOR, HELD_OUT).select(
            "label", "text", (part == 0).alias("checked")
        )
    )
    return _fitted(_sample(rows, _lexicon(mined_words(rows, voters=best_voters(rows)))))


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            scores = model.score(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])


def toxicity_report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of each document; null and empty texts are scored as clean ones.

    Rows that share an id are scored by their own texts, whole whatever their length. Without usable
    labels the stated lexicon decides. An empty table gives an empty result; further columns do not
    matter, whatever their names.
    """
    plain = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    model = train(plain, labels)
    scored = plain.transform(batchwise, lambda batches: _scored(batches, model), "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", DIVISOR) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
