"""Toxicity: embeddings of subword bags, averaged into a linear softmax, trained in numpy on labelled documents.

A word is the bag of its character n-grams (3 to 5, with word ends) and itself, each hashed to a row of one embedding
matrix; a window's vector is the mean over its words of their mean rows, and a softmax over two classes reads it. Rows
and softmax are trained together by Adagrad. Labels belong to documents, so a toxic document teaches through its most
toxic windows once a first pass over all windows has shown which those are, a clean one through all of its windows and
again through the one that looks most toxic. A
misspelt word shares most n-grams with the word it was, and so its vector.

A document's score is the highest probability of any of its windows (every run of ``WINDOW`` words): a few words in a
long text count as much as in a short one. The softmax is linear, so a word's share of a window's logit is one number, kept
for each distinct word.

Training takes at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` clean labelled documents, those of least hash of the id, and
of these the ones of ``MOST_CHARS`` characters at most; one in five of them is held out to set the cutoff. Everything is
scored, and scored whole.

Defined results: null or blank text scores 0 and is not toxic; null ids stay null; labels of unknown documents, null
labels and null ids teach nothing; an id that is labelled both ways is toxic, one with several texts teaches through the
first in order; without toxic or clean examples nothing is toxic; a score equal to the cutoff is toxic; repeated rows are
scored alike; extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded_words, slices, table, unit_hash

MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 2000, 3000, 50_000
WINDOW = 12
#: Windows that one step of the training adds up.
BATCH = 64
ROWS, WIDTH = 1 << 16, 8
EPOCHS = 4
_SEED = 7


def subwords(word: bytes) -> list[int]:
    """Rows of the embedding matrix for a word (UTF-8)."""
    text = f"<{word.decode('utf-8', 'ignore')}>"
    grams = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)} | {text}
    return [zlib.crc32(g.encode()) % ROWS for g in sorted(grams)]


def _spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i] + 1, ... of each i, ``counts[i]`` of them."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Model:
    """Embedding matrix and softmax; after training, logit shares of words."""

    def __init__(self) -> None:
        rng = np.random.default_rng(_SEED)
        self.rows = rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.cutoff = 1.1

    def word_logits(self, bags: list[list[int]]) -> np.ndarray:
        """For each bag, the difference of the logits of toxic and clean."""
        if not bags:
            return np.zeros(0, np.float32)
        counts = np.array([len(b) for b in bags])
        flat = np.fromiter((i for b in bags for i in b), np.int64, counts.sum())
        scalar = self.rows @ (self.out[:, 1] - self.out[:, 0])
        return np.add.reduceat(scalar[flat], np.cumsum(counts) - counts) / counts

    def train(self, documents: list[list[bytes]], toxic: np.ndarray) -> None:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in documents for w in d))}
        bags = [subwords(w) for w in vocabulary]
        counts = np.array([len(b) for b in bags])
        flat = np.fromiter((i for b in bags for i in b), np.int64, counts.sum())
        begin = np.cumsum(counts) - counts
        tokens = np.fromiter((vocabulary[w] for d in documents for w in d), np.int64, sum(map(len, documents)))
        length = np.array([min(WINDOW, len(d) - at) for d in documents for at in range(0, len(d), WINDOW)])
        of = np.repeat(np.arange(len(documents)), [-(-len(d) // WINDOW) for d in documents])
        start = np.cumsum(length) - length
        label = toxic[of].astype(np.int64)
        rng = np.random.default_rng(_SEED)
        square_rows = np.full((ROWS, WIDTH), 1e-6, np.float32)
        square_out, square_bias = np.full((WIDTH, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        rate = 0.3
        for epoch in range(EPOCHS):
            use = np.arange(len(length))
            if epoch:
                logit = self.word_logits(bags)
                score = np.add.reduceat(logit[tokens], start) / length
                most = np.full(len(documents), -np.inf)
                np.maximum.at(most, of, score)
                use = use[(label == 0) | (score >= most[of] - 1e-6)]
                hard = np.flatnonzero((label == 0) & (score >= most[of] - 1e-6))
                use = np.concatenate([use[label[use] == 0], np.repeat(use[label[use] == 1], 8), np.repeat(hard, 4)])
            rng.shuffle(use)
            for batch in np.array_split(use, max(1, len(use) // BATCH)):
                sizes = length[batch]
                words = tokens[_spread(start[batch], sizes)]
                row = np.repeat(np.arange(len(batch)), sizes)
                unique, inverse = np.unique(words, return_inverse=True)
                n = counts[unique]
                grams = flat[_spread(begin[unique], n)]
                of_gram = np.repeat(np.arange(len(unique)), n)
                word_vec = np.add.reduceat(self.rows[grams], np.cumsum(n) - n, axis=0) / n[:, None]
                x = np.add.reduceat(word_vec[inverse], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                z = x @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(batch)), label[batch]] -= 1
                d_out, d_bias = x.T @ p / len(batch), p.mean(axis=0)
                d_x = p @ self.out.T / sizes[:, None]
                order = np.argsort(inverse, kind="stable")
                first = np.searchsorted(inverse[order], np.arange(len(unique)))
                d_word = np.add.reduceat(d_x[row[order]], first, axis=0) / n[:, None]
                order = np.argsort(grams, kind="stable")
                touched, first = np.unique(grams[order], return_index=True)
                d_rows = np.add.reduceat(d_word[of_gram[order]], first, axis=0)
                square_rows[touched] += d_rows**2
                self.rows[touched] -= rate * d_rows / np.sqrt(square_rows[touched])
                square_out += d_out**2
                square_bias += d_bias**2
                self.out -= rate * d_out / np.sqrt(square_out)
                self.bias -= rate * d_bias / np.sqrt(square_bias)

    def settle(self, documents: list[list[bytes]], toxic: np.ndarray) -> None:
        """Set the cutoff: midway between the classes where they part best on held-out documents."""
        scores = Scorer(self).scores(documents)
        order = np.argsort(scores, kind="stable")
        right = np.concatenate([[0], np.cumsum(np.where(toxic[order], -1, 1))])
        k = np.flatnonzero(right == right.max())
        k = int(k[len(k) // 2])
        s = np.concatenate([[0.0], scores[order], [1.0]])
        self.cutoff = float((s[k] + s[k + 1]) / 2)


class Scorer(dict):
    """Scores documents; keeps the logit share of each distinct word."""

    def __init__(self, model: Model, limit: int = 500_000) -> None:
        super().__init__()
        self.bias = float(model.bias[1] - model.bias[0])
        self.scalar = model.rows @ (model.out[:, 1] - model.out[:, 0])
        self.limit = limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        bag = subwords(word)
        self[word] = share = sum(map(self.scalar.item, bag)) / len(bag)
        return share

    def scores(self, documents: list[list[bytes]]) -> np.ndarray:
        out = np.zeros(len(documents))
        for i, words in enumerate(documents):
            if words:
                total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(self.__getitem__, words), np.float64, len(words)))])
                n = min(WINDOW, len(words))
                out[i] = 1 / (1 + np.exp(-np.clip((total[n:] - total[:-n]).max() / n + self.bias, -500, 500)))
        return out


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model trained on the bounded sample of labelled documents."""
    given = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    known = given.groupBy("id").agg(F.max("label").alias("label"))
    sample = None
    for label, most in ((1, most_toxic), (0, most_clean)):
        part = known.filter(F.col("label") == label).orderBy(unit_hash("id"), "id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.length("text") <= MOST_CHARS)
    # At most most_toxic + most_clean pairs of numbers are sent to every task, and as many texts of MOST_CHARS come back.
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.id)
    words = [folded_words(r.text) for r in rows]
    toxic = np.array([r.label == 1 for r in rows], bool)
    held = np.array([zlib.crc32(str(r.id).encode()) % 5 == 0 for r in rows], bool)
    model = Model()
    if len({*toxic[~held].tolist()}) == 2:
        model.train([w for w, h in zip(words, held, strict=True) if not h], toxic[~held])
        there = held if len({*toxic[held].tolist()}) == 2 else np.ones(len(rows), bool)
        model.settle([w for w, h in zip(words, there, strict=True) if h], toxic[there])
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity, toxic) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.__new__(Model)
        vars(model).update(shared.value)
        scorer, cutoff = Scorer(model), model.cutoff
        for batch in batches:
            for part in slices(batch, "text"):
                s = scorer.scores([folded_words(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(s >= cutoff)], ["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with their scores."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("toxic").select("doc_id", "toxicity")


QUERIES = {"op9_toxicity": op9}
ORACLE_SQL: dict[str, str] = {}
