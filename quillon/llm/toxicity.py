"""Toxicity by weak supervision.

Many voters look at a text: words of lexicons, and patterns (whole words or
beginnings of words) that stand out among labelled rows. A generative model
with a hidden class estimates by EM how often each voter fires in either class,
and how voters depend on each other given the class; dependent voters share
their weight. The label of a training row is one more voter, with an accuracy
of its own, as labels have errors. A linear classifier over hashed words and
beginnings of words is then trained on the posterior labels, and scores texts.

Fitting takes at most ``MAX_TRAIN`` labelled rows (those with the smallest hash
of their id, so that any corpus gives a fair sample), each with all its
features, and runs on the driver. Rows that ``held_out`` names
are never used. Scoring is one pass over whole texts, without a shuffle.

Defined results: null text counts as empty and gets the score of a text without
features; rows without any labelled row get the score 0.5 throughout; repeated
rows get the same score; a label that is null is no label; of several labels of
one document the largest counts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back
from .wordhash import MARKS, SLICE, WordHasher, groups

#: Bounds of the fit: labelled rows, voters, weights.
MAX_TRAIN, MAX_VOTERS, MAX_WEIGHTS = 6_000, 200, 20_000
FEATURE_BITS = 22
BEGINNINGS = (4, 5, 6, 8)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Words of abuse, by language.
LEXICONS = {
    "en": (
        "clown disgusting dumb fool idiot imbecile loser lowlife moron pathetic "
        "scum stupid trash vermin worthless"
    ),
    "de": "abschaum arschloch depp dreckig dumm idioten trottel versager widerlich wertlos",
    "es": "asqueroso basura escoria estúpido imbécil inútil patético payaso perdedor tonto",
    "fr": "abruti crétin débile déchet dégoûtant imbécile minable ordure pathétique stupide",
}


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the decimal id, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def text_features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Over a column, in groups of rows: first row, number of rows, and the
    distinct (row, feature number) pairs as two arrays."""
    hasher = WordHasher(MARKS, latin=True)
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    for first, count, data, starts in groups(texts):
        if len(data) > SLICE:
            pairs = np.unique(hasher.long_features(data, BEGINNINGS) & mask)
        else:
            hashes, rows = hasher.features(data, starts, BEGINNINGS)
            pairs = np.unique((rows.astype(np.uint64) << np.uint64(FEATURE_BITS)) | (hashes & mask))
        yield first, count, (pairs >> np.uint64(FEATURE_BITS)).astype(np.int64), (pairs & mask).astype(np.int64)


def word_feature(word: str) -> int:
    hasher = WordHasher(MARKS, latin=True)
    return int(hasher.group(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64))[0][0]) & ((1 << FEATURE_BITS) - 1)


@dataclass
class LabelModel:
    """What EM has found: class balance, rates of firing by class (voters x 2)
    and the weight that each voter keeps beside those it depends on."""

    balance: float
    rates: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that does not fire abstains: it says nothing of the class."""
        each = votes @ ((np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])) * self.weight)
        return 1 / (1 + np.exp(-np.clip(each + np.log(self.balance / (1 - self.balance)), -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15) -> LabelModel:
    """EM from first guesses ``start`` of the class, whose mean is taken for
    the class balance throughout. ``votes``: rows x voters, 0 or 1."""
    votes = votes.astype(np.float32)
    belief = start.astype(np.float32)
    balance = float(np.clip(belief.mean(), 1e-3, 1 - 1e-3))
    model = None
    for _ in range(rounds):
        on = [(votes.T @ b + 0.1) / (b.sum() + 1) for b in (1 - belief, belief)]
        rates = np.clip(np.stack(on, 1), 1e-4, 1 - 1e-4)
        # What is left of each vote, given the class, shows which voters go together.
        rest = votes - (np.outer(1 - belief, rates[:, 0]) + np.outer(belief, rates[:, 1]))
        spread = np.sqrt((rest**2).sum(0)) + 1e-6
        together = np.clip((rest.T @ rest) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(together, 0)
        together[together < 0.1] = 0
        model = LabelModel(balance, rates, 1 / (1 + together.sum(0)))
        belief = model.posterior(votes)
    return model


@dataclass
class Classifier:
    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    bias: float

    def score(self, count: int, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
            own = self.features[at] == features
            total = np.bincount(rows[own], self.weights[at[own]], count)
        else:
            total = np.zeros(count)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def _odds(counts: np.ndarray, toxic: np.ndarray, rows: float, toxic_rows: float) -> np.ndarray:
    """Log odds ratio of features, less one standard error."""
    a, b = toxic + 0.5, counts - toxic + 0.5
    c, d = toxic_rows - toxic + 0.5, rows - toxic_rows - (counts - toxic) + 0.5
    odds = np.log(a * d / (b * c))
    return np.sign(odds) * np.maximum(0, np.abs(odds) - np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def train(rows: list[tuple[int, np.ndarray]]) -> Classifier:
    """From (label, feature numbers) of each training row."""
    if not rows:
        return Classifier(np.zeros(0, np.int64), np.zeros(0), 0.0)
    labels = np.array([y for y, _ in rows], np.float64)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for _, f in rows])
    known, column = np.unique(np.concatenate([f for _, f in rows]), return_inverse=True)
    known, column = known.astype(np.int64), column.astype(np.int32)
    counts = np.bincount(column, minlength=len(known)).astype(float)

    lexicon = np.array([word_feature(w) for words in LEXICONS.values() for w in words.split()])
    odds = _odds(counts, np.bincount(column, labels[row], len(known)), len(rows), labels.sum())
    odds[counts < 4] = 0
    voters = np.union1d(np.flatnonzero(np.isin(known, lexicon)), _patterns(odds, row, column, labels))
    place = np.full(len(known), -1)
    place[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters) + 3), np.float32)
    fires = place[column] >= 0
    votes[row[fires], place[column[fires]]] = 1
    votes[:, -3] = votes.max(1) == 0
    votes[:, -2], votes[:, -1] = labels, 1 - labels
    belief = fit_label_model(votes, 0.05 + 0.9 * labels).posterior(votes)

    odds = _odds(counts, np.bincount(column, belief[row], len(known)), len(rows), belief.sum())
    odds[counts < 3] = 0
    chosen = np.sort(np.argsort(-np.abs(odds), kind="stable")[:MAX_WEIGHTS])
    chosen = chosen[np.abs(odds[chosen]) > 0.5]
    place[:] = -1
    place[chosen] = np.arange(len(chosen))
    fires = place[column] >= 0
    weights, bias = _logistic(row[fires], place[column[fires]], len(chosen), belief)
    return Classifier(known[chosen], weights, bias)


def _patterns(odds: np.ndarray, row: np.ndarray, column: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Features that stand out among toxic rows, by odds; one whose toxic rows
    nearly all have three patterns already is passed over, so that each kind
    of abuse finds its voters."""
    ranked = np.argsort(-odds, kind="stable")[: 50 * MAX_VOTERS]
    ranked = ranked[odds[ranked] > 1]
    by_column = np.argsort(column, kind="stable")
    first = np.searchsorted(column[by_column], ranked)
    last = np.searchsorted(column[by_column], ranked, "right")
    covered, chosen = np.zeros(len(labels)), []
    for k, a, b in zip(ranked, first, last, strict=True):
        own = row[by_column[a:b]]
        own = own[labels[own] == 1]
        if (covered[own] < 3).mean() > 0.1:
            covered[own] += 1
            chosen.append(k)
            if len(chosen) == MAX_VOTERS:
                break
    return np.array(chosen, np.int64)


def _logistic(row: np.ndarray, column: np.ndarray, n: int, target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels: full gradients, steps by AdaGrad, small L2."""
    weights, bias = np.zeros(n), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    seen, seen_bias = np.full(n, 1e-8), 1e-8
    for _ in range(rounds):
        total = np.bincount(row, weights[column], len(target)) + bias
        wrong = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - target
        slope = np.bincount(column, wrong[row], n) + 0.01 * weights
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
        step = wrong.sum()
        seen_bias += step**2
        bias -= 0.3 * step / np.sqrt(seen_bias)
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Classifier:
    """Learn from the rows of ``docs`` that have a label and are not held out."""
    given = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna()
    given = given.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(given), "doc_id").select("toxic", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for first, count, rows, own in text_features(batch.column(1)):
                edges = np.searchsorted(rows, np.arange(count + 1))
                for k in range(count):
                    out[first + k] = own[edges[k] : edges[k + 1]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "features"])

    rows = texts.mapInArrow(features, "toxic int, features binary").collect()
    # The order of rows must not depend on partitions.
    rows.sort(key=lambda r: (r[0], bytes(r[1])))
    return train([(y, np.frombuffer(f, np.int32)) for y, f in rows])


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, count, rows, features in text_features(batch.column(2)):
                scores[first : first + count] = model.score(count, rows, features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (any columns, with text) that score below the
    threshold, as they are; one pass without a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, count, rows, features in text_features(batch.column(at)):
                scores[first : first + count] = model.score(count, rows, features)
            yield batch.filter(pa.array(scores < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
