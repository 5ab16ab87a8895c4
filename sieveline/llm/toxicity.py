"""Toxicity by subword bags: n-gram embeddings averaged into a linear softmax, trained in numpy.

A word, with its ends marked, is the bag of its character n-grams of length 3 to 6, hashed
to `BUCKETS` rows of an embedding table. A text of any length is the mean over all its
words' n-grams, in training and in scoring alike; a linear softmax over that mean gives
the two classes. Embeddings and softmax are trained jointly (AdaGrad, L2), so misspellings
never seen in training share rows with what was. As the softmax is linear, a word adds a
fixed amount to the margin, and one pass over a text scores it.

The cut is set on rows that a model has not seen: the training rows are dealt to `FOLDS`
folds, class by class, each fold is scored by a model of the others, and the margin that
best separates these out-of-fold margins (by F1) is put at score 0.7. All models train for
the same number of steps on batches of the same size, whatever the number of rows.

Training runs in one executor task, on a sample bounded in rows and in bytes: the labelled
rows, in the order of a hash of doc_id, up to `max_rows`, and of these as many as have
`max_bytes` of text together. No row is left out for its length but by that sum. Only the
fitted weights come to the driver. Scoring covers every whole text.

Labels: a doc_id labelled more than once is toxic if any label says so; null labels
count for nothing. Rows with crc32(doc_id as text) mod 3 = 1 are held out from training;
a null doc_id is hashed as "". If no training row remains, or only one class, the share
of toxic rows (0 without rows) is every text's score. With fewer rows of a class than
folds, the cut is set on the training rows themselves. Null and empty texts, and texts
without a word, get the score of the softmax's bias alone. Repeated rows train once and
get a row each. Columns besides the named ones are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, worker_cache

BITS, DIM, SIZES = 18, 8, (3, 4, 5, 6)
BUCKETS = 1 << BITS
PRIME, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
STEPS, RATE, L2, BATCH, FOLDS = 600, 0.3, 1e-4, 32, 2
#: Bounds of the training sample: rows, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 12_000, 64 << 20
THRESHOLD = 0.7
#: Words that a worker remembers; words whose n-grams are made at once.
CACHE, WORDS = 300_000, 20_000
WORD = re.compile(r"\w+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams, and for each the number of its word (in order)."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # code points to the word's end
    rolling, buckets, owners = np.zeros(len(chars), np.uint64), [], []
    for n in range(1, min(SIZES[-1], len(chars)) + 1):
        rolling[: len(chars) - n + 1] = rolling[: len(chars) - n + 1] * PRIME + chars[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            mixed = (rolling[at] + np.uint64(n)) * MIX
            buckets.append(((mixed ^ mixed >> np.uint64(29)) * MIX >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[at])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    down = np.argsort(owners, kind="stable")
    return buckets[down], owners[down]


@dataclass
class Model:
    weights: np.ndarray  # what each bucket adds to the margin toxic - clean
    bias: float = 0.0  # of the margin
    offset: float = 0.0  # the margin that is put at THRESHOLD
    constant: float | None = None


def margins(texts: list[str], model: Model, cache: dict[str, complex]) -> list[float]:
    """For each text the margin of the mean of its n-grams.

    cache: a word's sum of weights (real part) and number of n-grams (imaginary part).
    """
    split = [WORD.findall(t.lower()) for t in texts]
    if len(cache) >= CACHE:
        cache.clear()
    if new := list({w for words in split for w in words if w not in cache}):
        buckets, owners = grams(new)
        sums = np.bincount(owners, model.weights[buckets], len(new)) + 1j * np.bincount(owners, minlength=len(new))
        cache.update(zip(new, sums.tolist(), strict=True))
    both = (sum(map(cache.__getitem__, words)) for words in split)
    return [x.real / x.imag + model.bias if x else model.bias for x in both]


def pieces(texts: list, size: int = 1 << 20):
    """Runs of consecutive texts of about `size` code points."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


class Bags:
    """Texts as distinct words with counts, and words as n-grams; `used` are the buckets that occur."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.words, self.counts = [], []
        for t in texts:
            ids = np.array([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())], np.int32)
            words, counts = np.unique(ids, return_counts=True)
            self.words.append(words)
            self.counts.append(counts.astype(np.int32))
        known, found, sizes = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(known), WORDS):
            buckets, owners = grams(known[i : i + WORDS])
            found.append(buckets.astype(np.int32))
            sizes.append(np.bincount(owners, minlength=len(known[i : i + WORDS])))
        self.grams, self.sizes = np.concatenate(found), np.concatenate(sizes)
        self.used = np.flatnonzero(np.bincount(self.grams, minlength=BUCKETS))
        number_of = np.zeros(BUCKETS, np.int32)
        number_of[self.used] = np.arange(len(self.used))
        self.grams = number_of[self.grams]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def batch(self, rows: np.ndarray) -> tuple:
        """The batch's distinct words' n-grams and sizes; and by word of a text: the text, the word's place among these, and its share per n-gram."""
        many = np.array([len(self.words[i]) for i in rows])
        words, place = np.unique(np.concatenate([self.words[i] for i in rows]), return_inverse=True)
        counts, doc = np.concatenate([self.counts[i] for i in rows]), np.repeat(np.arange(len(rows)), many)
        total = np.bincount(doc, counts * self.sizes[words][place], len(rows))
        n = self.sizes[words]
        at = np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.grams[at], n, doc, place, (counts / total[doc]).astype(np.float32)

    def margins(self, rows: np.ndarray, delta: np.ndarray, bias: float) -> np.ndarray:
        """Margins of texts; delta: what each of `used` adds."""
        sums = np.concatenate(([0.0], np.cumsum(delta[self.grams], dtype=np.float64)))
        word = sums[self.starts + self.sizes] - sums[self.starts]
        return np.array([(word[w] * c).sum() / (self.sizes[w] * c).sum() + bias if len(w := self.words[i]) and len(c := self.counts[i]) else bias for i in rows])


def _trained(bags: Bags, rows: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """What each used bucket adds to the margin, and the bias, after STEPS batches of the given rows."""
    size = len(bags.used)
    e, w, b = rng.uniform(-0.1, 0.1, (size, DIM)).astype(np.float32), rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_e, seen_w, seen_b = np.full(size, 1e-8, np.float32), np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    rows = np.array([i for i in rows if len(bags.words[i])], np.int64)
    queue = np.zeros(0, np.int64)
    for _ in range(STEPS if len(rows) else 0):
        while len(queue) < BATCH:
            queue = np.concatenate((queue, rng.permutation(rows)))
        own, queue = queue[:BATCH], queue[BATCH:]
        f, n, doc, place, share = bags.batch(own)
        word = np.add.reduceat(e[f], np.cumsum(n) - n)
        mean = np.stack([np.bincount(doc, word[place, d] * share, BATCH) for d in range(DIM)], axis=1).astype(np.float32)
        z = mean @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), y[own]] -= 1
        to_mean, to_w, to_b = p @ w.T, mean.T @ p, p.sum(axis=0)
        to_word = np.stack([np.bincount(place, to_mean[doc, d] * share, len(n)) for d in range(DIM)], axis=1).astype(np.float32)
        down = np.argsort(f)
        first = np.flatnonzero(np.diff(f[down], prepend=-1))
        u = f[down[first]]
        to_e = np.add.reduceat(to_word[np.repeat(np.arange(len(n)), n)[down]], first) + L2 * e[u]
        seen_e[u] += (to_e**2).mean(axis=1)
        e[u] -= RATE * to_e / np.sqrt(seen_e[u])[:, None]
        seen_w += to_w**2
        w -= RATE * to_w / np.sqrt(seen_w)
        seen_b += to_b**2
        b -= RATE * to_b / np.sqrt(seen_b)
    return e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0])


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1, at the middle of its gap."""
    down = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[down])
    best = int(np.argmax(2 * hits / (np.arange(len(down)) + 1 + y.sum())))
    return float(z[down[best]] + z[down[min(best + 1, len(down) - 1)]]) / 2


def fit(texts: list[str], toxic: list[int], seed: int = 0) -> Model:
    """Train on given rows; the cut comes from out-of-fold margins."""
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), constant=float(y.mean()) if len(y) else 0.0)
    rng, bags, every = np.random.default_rng(seed), Bags(texts), np.arange(len(y))
    delta, bias = _trained(bags, every, y, rng)
    if min(y.sum(), len(y) - y.sum()) < FOLDS:
        z = bags.margins(every, delta, bias)
    else:
        z, fold = np.zeros(len(y)), np.zeros(len(y), np.int64)
        for c in (0, 1):
            own = rng.permutation(every[y == c])
            fold[own] = np.arange(len(own)) % FOLDS
        for k in range(FOLDS):
            z[fold == k] = bags.margins(every[fold == k], *_trained(bags, every[fold != k], y, rng))
    weights = np.zeros(BUCKETS, np.float32)
    weights[bags.used] = delta
    return Model(weights, bias, best_cut(z, y))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, toxic, text): the training rows in one partition, within both bounds.

    Ids, hashes and sizes of at most max_rows rows are ordered and summed first; then only
    the texts of those that fit are read.
    """
    few = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("id"), "id", "th"]
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    sized = few.join(F.broadcast(chosen), "id").select("id", "toxic", "th", F.octet_length("text").cast("long").alias("size")).distinct().orderBy(*order).limit(max_rows)
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = sized.withColumn("total", total).where(F.col("total") <= max_bytes).select("id", "th", "toxic")
    return few.join(F.broadcast(kept), ["id", "th"]).dropDuplicates(["id", "th"]).orderBy(*order).limit(max_rows).select("id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit, in one task, on labelled documents that are not held out."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b["text"].to_pylist()
            toxic += b["toxic"].to_pylist()
        m = fit(texts, toxic)
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "bias": [m.bias], "offset": [m.offset], "constant": pa.array([m.constant], pa.float64())})

    rows = sample(docs, labels, max_rows, max_bytes).mapInArrow(run, "weights binary, bias double, offset double, constant double").collect()
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), constant=0.0)
    return Model(np.frombuffer(rows[0]["weights"], np.float32), rows[0]["bias"], rows[0]["offset"], rows[0]["constant"])


def scorer(model: Model):
    """A function from texts to scores, for executors; the model's size is fixed by BUCKETS."""
    if model.constant is not None:
        return lambda texts: [model.constant for _ in texts]
    lift = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def score(texts: Iterator[str | None]) -> list[float]:
        cache = worker_cache(f"toxicity {zlib.crc32(model.weights.tobytes())}")
        z = np.array([x for run in pieces([t or "" for t in texts]) for x in margins(run, model, cache)])
        return (1 / (1 + np.exp(np.clip(model.offset - lift - z, -700, 700)))).tolist()

    return score


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document with its score."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain data, of fixed size

    def batch(rows: dict, f) -> dict:
        s = f(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")), batch, SCHEMA, lambda: {"f": scorer(Model(**sent.value))})


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays under THRESHOLD, with all their columns."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = scorer(Model(**sent.value))
        for texts in batches:
            yield pd.Series([s >= THRESHOLD for s in f(texts)], dtype=bool)

    return docs.where(~toxic(F.coalesce(F.col("text"), F.lit(""))))
