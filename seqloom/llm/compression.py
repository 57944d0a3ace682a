"""Quality by compression: a text is held against zstandard dictionaries of good and of bad labelled text.

Each text is compressed whole with either dictionary and, as a yardstick, with none. The normalised difference of
the two sizes, and how far the text shrinks at all, are calibrated to a probability by a logistic fit on labelled
texts that did not enter the dictionaries.

Bounds, all parameters: at most `sample` labelled rows per class, of at most `sample_bytes` each, are fitted on.
Every text is scored whole. Defined results: null and empty texts get the score of the empty text; rows without a
label, with a null label or without a document are not learned from; repeated rows are scored each; with one class
missing every text scores the share of the class at hand (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import crc_bucket, id_text, map_texts, rewrite_texts
from seqloom.session import spread

LEVEL = 3
#: Score of a document whose label has probability one half; a document is kept from this score on.
THRESHOLD = 0.3


def _sizes(texts: list[bytes], packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
    return np.array([[len(p.compress(t)) for p in packers] for t in texts], float).reshape(-1, len(packers))


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of both classes and the calibration of the features made with them."""

    good: bytes
    bad: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def packers(self) -> list[zstandard.ZstdCompressor]:
        bare = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        dictionaries = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
        return [zstandard.ZstdCompressor(dict_data=d, **bare) for d in dictionaries] + [zstandard.ZstdCompressor(**bare)]

    def features(self, texts: list[bytes], packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
        size = _sizes(texts, packers)
        length = np.array([len(t) for t in texts], float) + 16
        good, bad, none = size.T if len(size) else np.zeros((3, 0))
        return np.stack([(bad - good) / np.maximum(bad, good), (none - good) / length, (none - bad) / length,
                         np.log(none / length), np.log(np.minimum(good, bad) / length), np.log(length)], axis=1)

    def score(self, texts: list[bytes], packers: list[zstandard.ZstdCompressor]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        x = _expand((self.features(texts, packers) - self.centre) / self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Constant, linear and squared terms with all products of two."""
    x = np.clip(x, -6, 6)
    d = x.shape[1]
    return np.concatenate([np.ones((len(x), 1)), x, *[x[:, i:i + 1] * x[:, i:] for i in range(d)]], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Penalised logistic weights by Newton steps; the classes keep their shares."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_samples(good: list[bytes], bad: list[bytes], shares: tuple[int, int], dictionary_bytes: int = 110_000) -> CompressionModel:
    """Model of two lists of texts; every other text builds the dictionaries, the rest calibrates.

    `shares` are the numbers of all labelled texts of either class, which set the prior.
    """
    total = sum(shares)
    empty = CompressionModel(b"", b"", np.zeros(0), np.ones(0), np.zeros(0), shares[0] / total if total else 0.5)
    if len(good) < 4 or len(bad) < 4:
        return empty

    def book(texts: list[bytes]) -> bytes:
        # An even slice of every text, so that no long text fills the dictionary.
        each = max(64, dictionary_bytes // max(1, len(texts)))
        return b"\n".join(t[len(t) // 3:len(t) // 3 + each] for t in texts)[:dictionary_bytes]

    model = CompressionModel(book(good[::2]), book(bad[::2]), np.zeros(0), np.ones(0), np.zeros(0), empty.prior)
    packers = model.packers()
    rest = good[1::2] + bad[1::2]
    y = np.repeat([1.0, 0.0], [len(good[1::2]), len(bad[1::2])])
    x = model.features(rest, packers)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weights = _logistic(_expand((x - centre) / scale), y)
    # The sample holds both classes alike; the constant term moves the score to their shares among all labelled texts.
    weights[0] += np.log(max(shares[0], 1) / max(shares[1], 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return CompressionModel(model.good, model.bad, centre, scale, weights, empty.prior)


def fit(docs: DataFrame, labels: DataFrame, learn: DataFrame, sample: int = 3_000, sample_bytes: int = 65_536) -> CompressionModel:
    """Fit on the labelled documents whose id is in `learn(doc_id)`, at most `sample` of each class in digest order."""
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = marked.join(learn.select("doc_id").distinct(), "doc_id").withColumn("place", F.xxhash64("doc_id"))
    shares = dict(marked.groupBy("quality").count().collect())
    texts: dict[int, list[bytes]] = {}
    for label in (1, 0):
        chosen = marked.filter(F.col("quality") == label).orderBy("place", "doc_id").limit(sample).select("doc_id", "place")
        rows = (id_text(docs).join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text") <= sample_bytes)
                .groupBy("doc_id", "place").agg(F.min("text").alias("text")).orderBy("place", "doc_id").collect())
        texts[label] = [r["text"].encode() for r in rows]
    return fit_samples(texts[1], texts[0], (shares.get(1, 0), shares.get(0, 0)))


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """`(doc_id, score)` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list = []

    def each(ids, texts):
        if not held:
            held.append(shared.value.packers())
        return {"doc_id": ids, "score": shared.value.score(texts, held[0])}

    return map_texts(spread(id_text(docs)), "doc_id long, score double", each)


def keep(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least `threshold`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list = []

    def each(texts):
        if not held:
            held.append(shared.value.packers())
        return {"text": [None if t is None else t.decode() for t in texts], "_quality_score": shared.value.score([t or b"" for t in texts], held[0])}

    return rewrite_texts(spread(docs), "_quality_score double", each).filter(F.col("_quality_score") >= threshold).drop("_quality_score")


def learn_ids(docs: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(crc_bucket("doc_id", modulus) != held)
