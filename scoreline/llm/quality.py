"""A quality classifier: random-indexing word vectors, pooled per document, then a small network.

1. Word vectors. Each vocabulary bucket has a sparse random index vector; a bucket's word vector is the sum of
   the index vectors that stand within two words of it, anywhere in the corpus, scaled, plus its own. The
   sums are whole numbers, so they don't depend on the order in which tasks end. All documents count.
2. Pooling. A document is the mean of its words' vectors.
3. Network. Two layers in numpy, fitted on at most MAX_TRAIN labelled rows (chosen by hash), then a
   temperature that makes its probabilities fit labelled rows it wasn't trained on.

Words are folded to lower case; words in capitals, numbers, and words that were just said become one bucket
each; runs of signs are words of their own. Labels, languages, sources and ids are never inputs.

Defined results: null and empty texts get the score of a document without words; labels that are null, or of
documents that are missing, are left out; the first of several labels of one id by value counts; rows with a null
or repeated id are scored each, and a null id is not held out. Without both labels 0 and 1 there is nothing to tell
apart: the network is then not informed, and every score is the same, (ones + 1) / (labels + 2), so 0.5 without any
label. An empty table gives an empty table; columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm.common import with_arrow, sum_over

BUCKETS, DIM, NONZERO, REACH = 8192, 64, 2, 2
HIDDEN = 24
#: Labelled rows that the network is fitted on, at most.
MAX_TRAIN = 20_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
CAPITALS, NUMBER, AGAIN = 0, 1, 2
#: Buckets from 3 up to here hold runs of signs, those from here on hold words.
SIGNS = 512


class Buckets(dict):
    """Token to vocabulary bucket."""

    def __missing__(self, token: str) -> int:
        if token[0].isdigit():
            return NUMBER
        if len(token) > 1 and token.isupper():
            return CAPITALS
        code = zlib.crc32(token.lower()[:64].encode("utf-8", "surrogatepass"))
        bucket = SIGNS + code % (BUCKETS - SIGNS) if token[0].isalpha() else 3 + code % (SIGNS - 3)
        if len(self) > 400_000:
            self.clear()
        self[token] = bucket
        return bucket


def bucket_ids(text: str, buckets: Buckets) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    ids = np.fromiter(map(buckets.__getitem__, tokens), np.int64, len(tokens))
    again = np.zeros(len(ids), bool)
    for back in (1, 2):
        again[back:] |= ids[back:] == ids[:-back]
    return np.where(again & (ids >= SIGNS), AGAIN, ids)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector; the last row, for gaps between texts, is empty."""
    rng = np.random.default_rng(20)
    places = rng.integers(0, DIM, (BUCKETS + 1, NONZERO))
    signs = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return places, signs


def context_sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """The word vectors that the texts of one task add up to."""
    places, signs = index_vectors()
    sums = np.zeros((BUCKETS + 1) * DIM)
    buckets, gap, seen = Buckets(), np.full(REACH, BUCKETS), False
    for batch in batches:
        parts = [x for t in batch.column(0).to_pylist() if t for x in (bucket_ids(t, buckets), gap)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
        for start in range(0, len(ids), 1 << 20):
            part = ids[start : start + (1 << 20) + REACH]
            for reach in range(1, REACH + 1):
                end = max(0, min(1 << 20, len(part) - reach))
                for word, other in ((part[:end], part[reach : reach + end]), (part[reach : reach + end], part[:end])):
                    for k in range(NONZERO):
                        sums += np.bincount(word * DIM + places[other, k], signs[other, k], len(sums))
            seen = True
    return sums[: BUCKETS * DIM] if seen else None


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS rows of DIM: what the whole corpus says of each bucket. A few MB, whatever the corpus."""
    sums = sum_over(docs.select("text"), context_sums, BUCKETS * DIM, "<i8").reshape(BUCKETS, DIM).astype(float)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)
    places, signs = index_vectors()
    for k in range(NONZERO):
        sums[np.arange(BUCKETS), places[:BUCKETS, k]] += signs[:BUCKETS, k] / np.sqrt(NONZERO)
    return sums.astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """The mean vector of each text, summed in slices so that long texts need no more memory."""
    out = np.zeros((len(texts), DIM))
    for row, text in enumerate(texts):
        ids = bucket_ids(text, buckets) if text else ()
        for start in range(0, len(ids), 1 << 16):
            out[row] += vectors[ids[start : start + (1 << 16)]].sum(axis=0, dtype=np.float64)
        if len(ids):
            out[row] /= len(ids)
    return out


@dataclass
class Network:
    """Two layers over scaled inputs; temperature divides the last layer's output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    #: Whether it was fitted on labels of both kinds.
    informed: bool = True

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 1500) -> Network:
    """By Adam on batches of 512 with weight decay; one row in five only sets the temperature."""
    if len(np.unique(y)) < 2:
        width = x.shape[1]
        prior = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), informed=False)
    rng = np.random.default_rng(5)
    aside = rng.random(len(y)) < 0.2
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    xs, ys = x[~aside], y[~aside].astype(float)
    mean, scale = xs.mean(axis=0), xs.std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = (xs - mean) / scale
    state = [np.zeros(2), *[np.zeros((2, *p.shape)) for p in (net.w1, net.b1, net.w2)]]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(ys), min(512, len(ys)))
        hidden = np.tanh(z[pick] @ net.w1 + net.b1)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40)))
        d = (p - ys[pick]) / len(pick)
        back = np.outer(d, net.w2) * (1 - hidden**2)
        grads = [d.sum(), z[pick].T @ back + 1e-3 * net.w1, back.sum(axis=0), hidden.T @ d + 1e-3 * net.w2]
        moves = []
        for s, g in zip(state, grads):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            moves.append(0.01 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
        net.b2 -= moves[0]
        net.w1 -= moves[1]
        net.b1 -= moves[2]
        net.w2 -= moves[3]
    held, truth = (x[aside], y[aside]) if aside.any() else (x, y)
    logits = net.logits(held)

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, -np.where(truth == 1, 1, -1) * logits / t)))

    net.temperature = float(min(np.geomspace(0.25, 8, 121), key=loss))
    return net


def is_held_out(doc_id: Column) -> Column:
    """Whether a row's label stays out of every fit; not so for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs (doc_id, text) and a network fitted on labels (doc_id, quality)."""
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAIN)
    )
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), shared.value, buckets).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    # The broadcast side has MAX_TRAIN rows at most, and so has what is collected, but for repeated ids.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(pool, "doc_id long, label int, x binary")
        .orderBy("doc_id", "x")
        .limit(MAX_TRAIN)
        .collect()
    )
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], float).reshape(-1, DIM)
    return vectors, fit_network(x, np.array([r["label"] for r in rows], int))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """docs with score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], vars(model[1])))
    kept = docs.drop("score")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        vectors, net = shared.value[0], Network(**shared.value[1])
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), vectors, buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.score(x), pa.float64())], names=[*batch.schema.names, "score"])

    return with_arrow(kept, score, "score double")
