"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its character n-grams (hashed) and of the whole word; a window's is the
mean of its words' vectors; a softmax over it gives the class. A document is as toxic as its most toxic window, so that
a few words in a long text aren't averaged away. Unseen spellings share n-grams with seen ones.

Training starts on whole documents as one bag each, then repeats on each document's currently strongest window; both
parts move the embeddings and the softmax together. It uses at most `most_rows` labelled rows of each class, those with
the smallest hash of their id, which bounds what the driver gathers. As the model is linear above the embeddings, a
word's share of the score is one number; scoring looks it up once a word and never needs a vector.

Nulls, ties, empties: a null text is an empty one; an empty text scores the bias alone. Rows without a label are not used
for training; without any labelled row of both classes each text scores the smoothed share of label 1. Repeated rows
are scored alike. An id with several labels is toxic if one of them is; of several texts of an id the smallest is used for
training, so that no more than two times `most_rows` texts reach the driver. An empty table gives an empty table. Labels,
languages, sources and ids are no inputs of a score. Extra columns aren't read; carried ones must not be called as out_col.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .numbering import Numbers, remembered

WORD = re.compile(r"[^\W_]+(?:['’*@$0-9][^\W_]+)*")
LONGEST = 24  # longer words are cut into pieces of this many characters
ODD, EVEN = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9  # multipliers of the n-gram hash, fixed values


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def words_of(token: str) -> list[str]:
    """The words in one lower-cased white-space token."""
    if len(token) <= LONGEST and token.isalpha():
        return [token]
    return [w[i : i + LONGEST] for w in WORD.findall(token) for i in range(0, len(w), LONGEST)]


def grams(words: list[str], shortest: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the words, their ends marked, and of each whole word."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(words)), sizes)
    room = np.cumsum(sizes)[word] - np.arange(len(codes))  # characters from here to the word's end
    h, owners, buckets = codes.copy(), [], []
    for n in range(2, longest + 1):
        h = h[: max(len(codes) - n + 1, 0)] * np.uint64(ODD) + codes[n - 1 :]
        if n >= shortest:
            ok = np.flatnonzero(room[: len(h)] >= n)
            owners.append(word[ok])
            buckets.append(_bucket(h[ok] + np.uint64(n), bits))
    owners.append(np.arange(len(words)))
    buckets.append(_bucket(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)), bits))
    return np.concatenate(owners), np.concatenate(buckets)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(EVEN)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(ODD) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """weights: what each of 2**bits n-gram buckets adds to the logit of class 1; bias: the logit of an empty text."""

    weights: np.ndarray
    bias: float
    window: int
    shortest: int
    longest: int

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def word_logits(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        word, bucket = grams(words, self.shortest, self.longest, self.bits)
        return np.bincount(word, self.weights[bucket], len(words)) / np.bincount(word, minlength=len(words))


def window_means(values: np.ndarray, window: int) -> np.ndarray:
    """Means of all runs of `window` values; of all values if there are fewer."""
    if len(values) <= window:
        return values.mean(keepdims=True) if len(values) else np.zeros(1)
    total = np.concatenate(([0.0], np.cumsum(values)))
    return (total[window:] - total[:-window]) / window


class Scorer:
    """Scores texts. The first `most` tokens keep their logits, later ones for one call, so memory is bounded."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.index = Numbers()
        self.logit = np.zeros(1 << 16)  # of tokens that are one word; not a number for others
        self.several: dict[int, np.ndarray] = {}

    def _learn(self, new: list[str]) -> None:
        while len(self.index) > len(self.logit):
            self.logit = np.concatenate((self.logit, np.zeros_like(self.logit)))
        words = [words_of(t) for t in new]
        logits = self.model.word_logits([w for own in words for w in own])
        at = 0
        for token, own in zip(new, words, strict=True):
            number = self.index[token]
            self.logit[number] = logits[at] if len(own) == 1 else np.nan
            if len(own) != 1:
                self.several[number] = logits[at : at + len(own)]
            at += len(own)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        new, number = self.index.fresh(), self.index.__getitem__
        rows = []
        for text in texts:
            tokens = tokens_of(text)
            rows.append(np.fromiter(map(number, tokens), np.int64, len(tokens)))
        self._learn(new)
        out = np.zeros(len(texts))
        for i, row in enumerate(rows):
            values = self.logit[row]
            if np.isnan(values).any():
                values = np.concatenate([self.several[n] if n in self.several else self.logit[n : n + 1] for n in row.tolist()])
            if len(values):
                out[i] = window_means(values, self.model.window).max()
        if len(self.index) > self.most:
            for token in new:
                self.several.pop(self.index[token], None)
            self.index.forget(new)
        return 1 / (1 + np.exp(-np.clip(out + self.model.bias, -60, 60)))


def train(
    texts: list[str | None], labels: list[int], bits: int = 18, dim: int = 6, window: int = 2, shortest: int = 3, longest: int = 6,
    least: int = 3, bag_rounds: int = 12, window_rounds: int = 120, rate: float = 1.0, decay: float = 1e-8, seed: int = 7,
) -> Model:
    """Fit embeddings and softmax on labelled texts; every fourth of them only sets the bias.

    N-grams seen in fewer than `least` words of the texts keep a zero vector, so that single labels aren't learned by heart.
    """
    y = np.array(labels, np.int64)
    base = (y.sum() + 1) / (len(y) + 10)
    fitted = np.arange(len(y)) % 4 != 3
    if len(np.unique(y[fitted])) < 2:
        return Model(np.zeros(1, np.float32), float(np.log(base / (1 - base))), window, shortest, longest)
    own = y[fitted]
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for t in tokens_of(x) for w in words_of(t)], np.int64) for x, f in zip(texts, fitted, strict=True) if f]
    vocabulary = vocabulary or {"": 0}
    in_docs = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(vocabulary))
    listed, seen, sizes = list(vocabulary), np.zeros(1 << bits), np.zeros(len(vocabulary), np.int64)
    parts = range(0, len(listed), 10_000)  # in parts, to bound memory
    for at in parts:
        word, bucket = grams(listed[at : at + 10_000], shortest, longest, bits)
        seen += np.bincount(bucket, in_docs[at + word], 1 << bits)
        sizes[at : at + 10_000] = np.bincount(word)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for at in parts:
        word, bucket = grams(listed[at : at + 10_000], shortest, longest, bits)
        common = np.flatnonzero(seen[bucket] >= least)
        common = common[np.argsort(word[common], kind="stable")]
        kept.append(((at + word[common]).astype(np.int32), bucket[common].astype(np.int32)))
    word, flat = (np.concatenate(x) for x in zip(*kept, strict=True))
    known, flat = np.unique(flat, return_inverse=True)
    begins = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    rng = np.random.default_rng(seed)
    embed, soft, bias = rng.normal(0, 0.1, (len(known), dim)), rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    slow_e, slow_s, slow_b = np.full(len(known), 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)  # Adagrad sums
    weight = np.where(own == 1, 0.5 / own.sum(), 0.5 / (len(own) - own.sum()))
    lengths = np.array([len(d) for d in docs])
    every, owner = np.concatenate(docs), np.repeat(np.arange(len(docs)), lengths)
    for turn in range(bag_rounds + window_rounds):
        used, of = every, owner
        if turn >= bag_rounds:
            logit = np.bincount(word, (embed @ (soft[:, 1] - soft[:, 0]))[flat], len(vocabulary)) / sizes
            starts = [int(window_means(logit[d], window).argmax()) for d in docs]
            parts = [d[at : at + window] for d, at in zip(docs, starts, strict=True)]
            used, of = np.concatenate(parts), np.repeat(np.arange(len(docs)), [len(x) for x in parts])
        words, at = np.unique(used, return_inverse=True)
        spans = begins[words + 1] - begins[words]
        entry = np.repeat(begins[words] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        row, gram = np.repeat(np.arange(len(words)), spans), flat[entry]
        share = 1.0 / np.maximum(np.bincount(of, minlength=len(docs)), 1)[of]
        bags = np.empty((len(docs), dim))
        for k in range(dim):
            vector = np.bincount(row, embed[gram, k], len(words)) / sizes[words]
            bags[:, k] = np.bincount(of, vector[at] * share, len(docs))
        z = bags @ soft + bias
        error = np.exp(z - z.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(own)), own] -= 1
        error *= weight[:, None]
        to_bag = error @ soft.T
        to_gram = decay * embed
        for k in range(dim):
            to_word = np.bincount(at, to_bag[of, k] * share, len(words)) / sizes[words]
            to_gram[:, k] += np.bincount(gram, to_word[row], len(known))
        to_soft, to_bias = bags.T @ error + 1e-4 * soft, error.sum(axis=0)
        slow_e += (to_gram**2).sum(axis=1)
        slow_s += to_soft**2
        slow_b += to_bias**2
        embed -= rate * to_gram / np.sqrt(slow_e)[:, None]
        soft -= rate * to_soft / np.sqrt(slow_s)
        bias -= rate * to_bias / np.sqrt(slow_b)
    weights = np.zeros(1 << bits, np.float32)
    weights[known] = embed @ (soft[:, 1] - soft[:, 0])
    model = Model(weights, float(bias[1] - bias[0]), window, shortest, longest)
    rest = [i for i in np.flatnonzero(~fitted)]
    return _calibrated(model, [texts[i] for i in rest], y[rest])


def _calibrated(model: Model, texts: list[str | None], y: np.ndarray) -> Model:
    """The bias at which a score of 0.5 costs least among rows not trained on, in the middle of all such; a clean text
    taken for a toxic one costs as much as two toxic ones that are missed."""
    if len(np.unique(y)) < 2:
        return model
    bias, model.bias = model.bias, 0.0
    s = np.clip(Scorer(model)(texts), 1e-15, 1 - 1e-15)
    logit = np.log(s / (1 - s))
    order = np.argsort(logit, kind="stable")
    errors = np.concatenate(([0], np.cumsum(np.where(y[order] == 1, 1, -2))))  # with the cut above the first k rows
    best = np.flatnonzero(errors == errors.min())
    best = best[(best > 0) & (best < len(y))]
    if not len(best):
        model.bias = bias
        return model
    k = int(best[len(best) // 2])
    model.bias = float(-(logit[order[k - 1]] + logit[order[k]]) / 2)
    return model


def gather_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str | None], list[int]]:
    """At most most_rows labelled texts of each class whose id isn't held out, smallest id hash first."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for y in (0, 1):
        own = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # twice most_rows ids at most, and a row for each: a hot id's rows are reduced before they are sent
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["y"] for r in rows]


def held_out(id_col: str) -> F.Column:
    """Whether a row is kept from training: crc32 of the id as text, mod 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scorer(model: Model) -> Scorer:
    """The worker's scorer of a model."""
    return remembered(("scorer", model.bias, zlib.crc32(model.weights.tobytes())), lambda: Scorer(model))


def _scored(model: Model, n_carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = scorer(part.column(n_carry).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_carry], pa.array(scores)], names=[*part.schema.names[:n_carry], "_score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """The carried columns of every row and its score, 0 to 1. out_col must not be among the carried."""
    shared.small_batches(docs.sparkSession)
    cols = [*carry, text_col]
    rows = docs.select(*[F.col(c).cast("string").alias("_t") if i == len(carry) else F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)), "_score double"])
    out = rows.mapInArrow(_scored(model, len(carry)), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], F.col("_score").alias(out_col))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 1200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    shared.small_batches(docs.sparkSession)
    return train(*gather_rows(docs, labels, most_rows, id_col, text_col, label_col))
