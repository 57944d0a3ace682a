"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word forward and backward, labels every position with a probability per language and
is trained in numpy by backpropagation through time. A document's probabilities pool the log probabilities of all its
positions. States start afresh at every word (a run of letters and non-ASCII bytes, A-Z lower-cased, cut every
`SPAN` bytes), so a word gives the same labels wherever it stands and a task computes a repeated word once.

Bounds, parameters: the network is fitted on at most `sample` labelled texts per language, of at most `sample_bytes` each.
Every text is labelled whole. Defined results: a null text or one without a letter is `und` with score 0; rows with a
null language are not learned from; with no language to learn every text is `und`; ties go to the language that sorts first;
repeated rows are labelled each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import id_text, map_texts
from seqloom.session import spread

SPAN = 24
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words whose labels a worker remembers; further words are computed again where they occur.
REMEMBER = 300_000


def words_of(text: bytes) -> list[bytes]:
    """Words of a text; longer ones in parts of `SPAN` bytes."""
    words = text.translate(_FOLD).split()
    if words and max(map(len, words)) > SPAN:
        words = [w[i:i + SPAN] for w in words for i in range(0, len(w), SPAN)]
    return words


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words as rows padded with zero, and their lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = int(length.max())
    flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8)
    return flat.reshape(len(words), width), length


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Gru:
    """One direction: gates z and r and candidate c from the byte's row of `x` and the state times `h`."""

    def __init__(self, x: np.ndarray, h: np.ndarray):
        self.x, self.h = x, h

    @property
    def size(self) -> int:
        return self.h.shape[0]

    def forward(self, bytes_: np.ndarray, live: np.ndarray, keep: bool = False):
        """States after each step, `(steps, rows, size)`; rows that have ended keep their state."""
        n, d = bytes_.shape[1], self.size
        state = np.zeros((bytes_.shape[0], d), self.x.dtype)
        states, memory = [], []
        for t in range(n):
            gate = self.x[bytes_[:, t]]
            zr = _sigmoid(gate[:, :2 * d] + state @ self.h[:, :2 * d])
            z, r = zr[:, :d], zr[:, d:]
            c = np.tanh(gate[:, 2 * d:] + (r * state) @ self.h[:, 2 * d:])
            new = np.where(live[:, t:t + 1], (1 - z) * state + z * c, state)
            if keep:
                memory.append((state, z, r, c))
            state = new
            states.append(state)
        return np.stack(states), memory

    def backward(self, bytes_: np.ndarray, live: np.ndarray, memory: list, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of `x` and `h` from those of the states, through all steps back to the first."""
        d = self.size
        gx, gh = np.zeros_like(self.x), np.zeros_like(self.h)
        carry = np.zeros_like(outer[0])
        for t in range(len(memory) - 1, -1, -1):
            state, z, r, c = memory[t]
            total = outer[t] + carry
            here = np.where(live[:, t:t + 1], total, 0)
            dc = here * z * (1 - c * c)
            dz = here * (c - state) * z * (1 - z)
            back = dc @ self.h[:, 2 * d:].T
            dr = back * state * r * (1 - r)
            both = np.concatenate([dz, dr], axis=1)
            np.add.at(gx, bytes_[:, t], np.concatenate([both, dc], axis=1))
            gh[:, :2 * d] += state.T @ both
            gh[:, 2 * d:] += (r * state).T @ dc
            carry = here * (1 - z) + back * r + both @ self.h[:, :2 * d].T + (total - here)
        return gx, gh


@dataclass
class LanguageModel:
    """Both directions and the output layer over their joined states."""

    languages: list[str]
    ahead: Gru
    behind: Gru
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], size: int, seed: int) -> "LanguageModel":
        rng = np.random.default_rng(seed)

        def draw(rows: int, columns: int) -> np.ndarray:
            return (rng.standard_normal((rows, columns)) / np.sqrt(size)).astype(np.float32)

        return cls(languages, Gru(draw(256, 3 * size), draw(size, 3 * size)), Gru(draw(256, 3 * size), draw(size, 3 * size)),
                   draw(2 * size, len(languages)), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.x, self.ahead.h, self.behind.x, self.behind.h, self.out, self.bias]

    def _states(self, words: np.ndarray, length: np.ndarray, keep: bool = False):
        live = np.arange(words.shape[1]) < length[:, None]
        forward, m1 = self.ahead.forward(words, live, keep)
        # Backward: columns reversed, so that a row's padding comes first and leaves the state at zero.
        backward, m2 = self.behind.forward(words[:, ::-1], live[:, ::-1], keep)
        return live, np.concatenate([forward, backward[::-1]], axis=2), m1, m2

    def log_probabilities(self, words: np.ndarray, length: np.ndarray):
        """Log probabilities `(steps, rows, languages)` of every position and the mask of real positions."""
        live, states, *_ = self._states(words, length)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True)), live

    def step(self, words: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions and the gradients of all weights."""
        live, states, m1, m2 = self._states(words, length, keep=True)
        logits = states @ self.out + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        mask = live.T[:, :, None]
        count = live.sum()
        loss = -float(np.log(np.maximum(p[:, np.arange(len(label)), label], 1e-12))[live.T].sum() / count)
        delta = p.copy()
        delta[:, np.arange(len(label)), label] -= 1
        delta = np.where(mask, delta, 0) / np.float32(count)
        size = self.ahead.size
        flat, flat_delta = states.reshape(-1, 2 * size), delta.reshape(-1, delta.shape[2])
        back = delta @ self.out.T
        gx1, gh1 = self.ahead.backward(words, live, m1, back[:, :, :size])
        gx2, gh2 = self.behind.backward(words[:, ::-1], live[:, ::-1], m2, back[::-1, :, size:])
        return loss, [gx1, gh1, gx2, gh2, flat.T @ flat_delta, flat_delta.sum(axis=0)]

    def label_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: log probabilities summed over its positions, and positions labelled with each language."""
        sums = np.zeros((len(words), len(self.languages)), np.float32)
        labels = np.zeros((len(words), len(self.languages)), np.int32)
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        for at in range(0, len(order), 4_096):
            some = order[at:at + 4_096]
            log_p, live = self.log_probabilities(*_matrix([words[i] for i in some]))
            mask = live.T
            sums[some] = np.where(mask[:, :, None], log_p, 0).sum(axis=0)
            best = log_p.argmax(axis=2)
            for k in range(len(self.languages)):
                labels[some, k] = ((best == k) & mask).sum(axis=0)
        return sums, labels


def fit_words(words: dict[str, Counter], size: int = 16, rounds: int = 4, batch: int = 256, rate: float = 0.01, seed: int = 1, most: int = 12_000) -> LanguageModel:
    """Train on words per language, each at most `most` distinct ones in order of count; Adam steps over shuffled batches."""
    languages = sorted(words)
    rows = [(w, i, n) for i, name in enumerate(languages) for w, n in sorted(words[name].items(), key=lambda x: (-x[1], x[0]))[:most]]
    model = LanguageModel.start(languages, size, seed)
    if not rows or len(languages) < 2:
        return model
    # A word that stands often is drawn more often, but not in proportion: the root of its count.
    rng = np.random.default_rng(seed)
    label = np.array([i for _, i, _ in rows])
    weight = np.sqrt(np.array([n for *_, n in rows], float))
    for i in range(len(languages)):
        weight[label == i] /= weight[label == i].sum()
    weight /= weight.sum()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in model.weights()]
    steps = max(1, rounds * len(rows) // batch)
    for step in range(1, steps + 1):
        some = rng.choice(len(rows), batch, p=weight)
        matrix, length = _matrix([rows[i][0] for i in some])
        _, gradients = model.step(matrix, length, label[some])
        now = rate * (1 - step / (steps + 1))
        for w, g, (m, v) in zip(model.weights(), gradients, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(w.dtype)
    return model


def fit(docs: DataFrame, learn, sample: int = 300, sample_bytes: int = 20_000, most_languages: int = 200) -> LanguageModel:
    """Learn from the rows where `learn` holds: texts in digest order, so many and so long per language.

    More than `most_languages` languages raise, because the sample would no longer be small.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("doc_id", "lang").alias("place"), "text")
    rows = rows.filter(F.octet_length("text") <= sample_bytes)
    narrow = rows.select("lang", "place").withColumn("part", F.pmod("place", F.lit(256)))
    if narrow.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError("too many languages")
    first = narrow.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("place"))).filter(F.col("n") <= sample)
    chosen = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).filter(F.col("n") <= sample).select("lang", "place")
    found = rows.join(F.broadcast(chosen.distinct()), ["lang", "place"]).select("lang", "text").orderBy("lang", "place", "text").collect()
    words: dict[str, Counter] = {}
    for r in found:
        words.setdefault(r["lang"], Counter()).update(words_of(r["text"].encode()))
    return fit_words(words)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`(doc_id, lang_pred, score, n_positions, agreeing)` per row: agreeing positions carry the predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    book: dict[bytes, int] = {}
    held: dict[str, np.ndarray] = {}

    def each(ids, texts):
        net = shared.value
        n = len(net.languages)
        out: dict[str, list] = {"doc_id": ids, "lang_pred": [], "score": [], "n_positions": [], "agreeing": []}
        split = [words_of(t) for t in texts]
        new = sorted({w for words in split for w in words if w not in book}) if n > 1 else []
        fresh: dict[bytes, int] = {}
        if new:
            sums, labels = net.label_words(new)
            start = len(book)
            room = max(0, REMEMBER - start)
            if room:
                held.setdefault("sums", np.zeros((REMEMBER, n), np.float32))[start:start + room][:len(new)] = sums[:room]
                held.setdefault("labels", np.zeros((REMEMBER, n), np.int16))[start:start + room][:len(new)] = labels[:room]
                book.update(zip(new[:room], range(start, start + room)))
            fresh = dict(zip(new[room:], range(room, len(new))))
        for text, words in zip(texts, split):
            if not n or not any(map(str.isalpha, text.decode())):
                for name, value in (("lang_pred", "und"), ("score", 0.0), ("n_positions", 0), ("agreeing", 0)):
                    out[name].append(value)
                continue
            pooled, marks = np.zeros(n), np.zeros(n, np.int64)
            if n > 1:
                places = np.fromiter(map(book.get, words, repeat(-1)), np.int64, len(words))
                known = places[places >= 0]
                if len(known):
                    pooled += held["sums"][known].sum(axis=0, dtype=float)
                    marks += held["labels"][known].sum(axis=0, dtype=np.int64)
                if len(known) < len(words):
                    late = [fresh[words[i]] for i in np.flatnonzero(places < 0).tolist()]
                    pooled += sums[late].sum(axis=0, dtype=float)
                    marks += labels[late].sum(axis=0, dtype=np.int64)
            best = int(pooled.argmax())
            share = np.exp(pooled - pooled.max())
            out["lang_pred"].append(net.languages[best])
            out["score"].append(float(share[best] / share.sum()))
            out["n_positions"].append(sum(map(len, words)))
            out["agreeing"].append(int(marks[best]))
        return out

    return map_texts(spread(id_text(docs)), "doc_id long, lang_pred string, score double, n_positions long, agreeing long", each)
