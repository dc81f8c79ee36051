"""Toxicity scores from subword bags: character n-gram vectors averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, so a misspelling never seen shares most
of a known word's vectors; a stretch of words is the mean of its words.  Vectors and softmax weights
are learnt together in numpy.  A text scores as its worst stretch, and is trained that way: of a toxic
text the stretch that scores highest is its example, of a clean text each of its worst ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.common import RecentCache, id_and_text

BUCKETS, WIDTH = 1 << 16, 8
SHORTEST, LONGEST = 3, 6
STRETCH = 6  # words
WORD = 200  # characters
EPOCHS = 8, 60  # least, and most where rows are few
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_"
# The model is fitted on at most so many labelled rows of each class, taken in the order of a hash.
SAMPLE = 1500


def plain(word: str) -> str:
    return word.lower().strip(EDGES)


def words_of(text: str) -> list[str]:
    """White-space separated words; one longer than ``WORD`` is taken in pieces of that length."""
    words = text.split()
    if max(map(len, words), default=0) <= WORD:
        return words
    return [word[at:at + WORD] for word in words for at in range(0, len(word), WORD)]


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams, and of the word itself."""
    marked = f"<{word}>".encode()
    size = len(marked)
    grams = [marked]
    for n in range(SHORTEST, LONGEST + 1):
        grams += [marked[i:i + n] for i in range(size - n + 1)]
    return [code & (BUCKETS - 1) for code in map(zlib.crc32, dict.fromkeys(grams))]


def stretch_means(values: np.ndarray) -> np.ndarray:
    """Means of all stretches of words, of the whole text if it is shorter."""
    if len(values) <= STRETCH:
        return np.array([values.mean() if len(values) else 0.0])
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[STRETCH:] - sums[:-STRETCH]) / STRETCH


@dataclass
class Model:
    """One number per bucket (vector times softmax weights), a bias, and a scale of the score."""

    buckets: list[float]
    bias: float
    centre: float
    slope: float

    def word(self, word: str) -> float:
        ids = subwords(plain(word))
        return sum(map(self.buckets.__getitem__, ids)) / len(ids)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias - self.centre), -50, 50))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Vectors and weights by Adagrad on the softmax loss, then a logistic scale of the texts' scores."""
    labels = np.array(labels, np.int64)
    number, grams, words = {}, [], []
    for text in texts:
        row = []
        for raw in words_of(text):
            word = plain(raw)
            if word not in number:
                number[word] = len(number)
                grams.append(subwords(word))
            row.append(number[word])
        words.append(np.array(row, np.int64))
    counts = np.array([len(g) for g in grams] or [1])
    flat = np.concatenate([np.array(g) for g in grams]) if grams else np.zeros(1, np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    random = np.random.default_rng(11)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = random.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    past_vectors, past_weights, past_bias = np.full_like(vectors, 1e-6), np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)

    def word_margins() -> np.ndarray:
        bucket = vectors @ (weights[:, 1] - weights[:, 0])
        return np.add.reduceat(bucket[flat], begins) / counts

    # A quarter of the rows only sets the scale: on rows it has learnt the model is too sure.
    kept_back = np.arange(len(words)) % 4 == 3
    if min(np.bincount(labels[kept_back], minlength=2)) < 5:
        kept_back[:] = False
    learnt = [row for row, back in zip(words, kept_back) if not back]
    learnt_labels = labels[~kept_back]
    first_guess = _one_sided(learnt, learnt_labels, len(number))
    least, most = EPOCHS
    epochs = min(most, max(least, 8_000 // max(1, len(texts))))
    for epoch in range(epochs):
        margins = word_margins() if epoch > epochs // 2 else first_guess
        examples, targets = [], []
        for row, label in zip(learnt, learnt_labels):
            if not len(row):
                continue
            if len(row) <= STRETCH:
                picked = [0]
            else:
                means = stretch_means(margins[row])
                picked = np.argsort(-means)[: 1 if label else 4]
                if not label:
                    picked = np.append(picked, random.integers(0, len(means), 4))
            for at in picked:
                examples.append(np.resize(row[at:at + STRETCH], STRETCH) if len(row) < STRETCH else row[at:at + STRETCH])
                targets.append(label)
        if not examples:
            break
        examples, targets = np.stack(examples), np.array(targets)
        balance = np.where(targets == 1, 0.5 / max(1, (targets == 1).sum()), 0.5 / max(1, (targets == 0).sum())) * len(targets)
        order = random.permutation(len(examples))
        for part in np.array_split(order, max(1, len(order) // 512)):
            used, place = np.unique(examples[part], return_inverse=True)
            sizes = counts[used]
            ids = flat[np.repeat(begins[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())]
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of_word = np.add.reduceat(vectors[ids], edges, axis=0) / sizes[:, None]
            hidden = of_word[place.reshape(len(part), STRETCH)].mean(axis=1)
            logits = hidden @ weights + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(part)), targets[part]] -= 1
            chance *= balance[part, None] / len(part)
            to_hidden = chance @ weights.T / STRETCH
            to_word = np.zeros_like(of_word)
            np.add.at(to_word, place.reshape(-1), np.repeat(to_hidden, STRETCH, axis=0))
            to_gram = np.repeat(to_word / sizes[:, None], sizes, axis=0)
            touched, where = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(where, to_gram[:, d], len(touched)) for d in range(WIDTH)], axis=1)
            past_vectors[touched] += step**2
            vectors[touched] -= (0.5 * step / np.sqrt(past_vectors[touched])).astype(np.float32)
            for value, past, change in ((weights, past_weights, hidden.T @ chance), (bias, past_bias, chance.sum(axis=0))):
                past += change**2
                value -= (0.1 * change / np.sqrt(past)).astype(np.float32)
    bucket = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64)
    margins = np.add.reduceat(bucket[flat], begins) / counts
    worst = np.array([stretch_means(margins[row]).max() if len(row) else 0.0 for row in words]) + float(bias[1] - bias[0])
    fresh = kept_back if kept_back.any() else ~kept_back
    centre, slope = _scale(worst[fresh], labels[fresh])
    return Model(bucket.tolist(), float(bias[1] - bias[0]), centre, slope)


def _one_sided(words: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """How far a word's share of toxic texts exceeds its share of clean ones, in rough standard errors.

    Points to a toxic text's example until the vectors can.
    """
    texts = np.zeros((2, max(1, size)))
    for row, label in zip(words, labels):
        texts[label, np.unique(row)] += 1
    totals = [max(1, (labels == c).sum()) for c in (0, 1)]
    share = (texts.sum(axis=0) + 1) / (sum(totals) + 2)
    excess = np.maximum(texts[1] / totals[1] - texts[0] / totals[0], 0)
    return excess / np.sqrt(share * (1 / totals[0] + 1 / totals[1]))


def _scale(worst: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The margin where errors of both classes balance, and how fast the score rises there."""
    if not len(worst) or labels.min() == labels.max():
        return 0.0, 1.0
    toxic, clean = np.sort(worst[labels == 1]), np.sort(worst[labels == 0])
    cuts = np.unique(worst)
    middle = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    errors = np.searchsorted(toxic, middle) / len(toxic) + 1 - np.searchsorted(clean, middle) / len(clean)
    best = middle[errors <= errors.min() + 1e-12]
    spread = max(1e-3, float(np.median(toxic) - np.median(clean)))
    return float(best[len(best) // 2]), 8 / spread


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``labels.toxic`` of rows that are not held out, at most ``sample`` of each class.

    Rows without a label, id or text teach nothing; of two labels for one document both count.  With
    one class only, every score is near one half.
    """
    marked = labels.select(F.col("doc_id").alias("_doc"), "toxic").where("toxic IN (0, 1)").where(~held_out(F.col("_doc")))
    parts = []
    for label in (0, 1):
        chosen = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("_doc"), "_doc").limit(sample)
        parts.append(chosen)
    picked = parts[0].unionByName(parts[1])
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(
        picked, F.col("doc_id") == F.col("_doc")
    ).select("_doc", "toxic", "text").toPandas().sort_values(["_doc", "toxic", "text"])
    return fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist())


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``; null and empty texts score as no words.

    The model, half a megabyte whatever the corpus, travels with the function.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        look = RecentCache(own.word, 200_000).__getitem__
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                margins = np.fromiter(map(look, words), np.float64, len(words))
                scores.append(own.score(float(stretch_means(margins).max())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    scored = id_and_text(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
