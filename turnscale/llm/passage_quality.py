"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound_batches

#: Words of a passage, buckets of hashed words, bytes of text encoded at once.
PASSAGE, BUCKETS, BLOCK = 64, 128, 1 << 22
#: Classes of bytes that are counted: each byte's class is the place of the first set that has it.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"!", b"?", b".", b",", b"#*$%&|<>", b"@", b"=", b"\"'()[]{}", b":;/\\_-+^~`", bytes(range(128, 256))]
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _n, _set in reversed(list(enumerate(CLASSES))):
    CLASS_OF[list(_set)] = _n
N_CLASSES = len(CLASSES) + 1
FEATURES = N_CLASSES + 6 + BUCKETS


def encode_passages(text: str | None) -> np.ndarray:
    """A row of features for every passage of PASSAGE words of the whole text; one row of zeros if it has no word.

    Shares of the byte classes; mean and spread of word lengths, share of distinct words, of words that the passage
    before has, of words in capitals, passage length; and shares of hashed words.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n = len(words)
    passages = -(-n // PASSAGE)
    of_word = np.arange(n) // PASSAGE
    per = np.bincount(of_word, minlength=passages).astype(np.float64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    # The bytes of a word and one space stand for the passage's text, and line ends are counted by themselves.
    classes = CLASS_OF[np.frombuffer(b" ".join(words), np.uint8)]
    of_byte = np.repeat(of_word, lengths + 1)[:-1]
    counts = np.bincount(of_byte * N_CLASSES + classes, minlength=passages * N_CLASSES).reshape(passages, N_CLASSES).astype(np.float64)
    counts[:, 4] = data.count(b"\n") / passages
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    mean = np.bincount(of_word, lengths, passages) / per
    spread = np.sqrt(np.maximum(np.bincount(of_word, lengths * lengths, passages) / per - mean**2, 0))
    order = np.lexsort((hashes, of_word))
    first = np.ones(n, bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order], first, passages) / per
    pairs = (of_word.astype(np.int64) << 32) | hashes
    again = np.bincount(of_word, np.isin(pairs - (1 << 32), pairs), passages) / per
    ends = np.cumsum(lengths + 1) - 1
    upper = np.concatenate([[0], np.cumsum(classes == 0)])
    capitals = np.bincount(of_word, (upper[ends] - upper[ends - lengths]) * 2 > lengths, passages) / per
    bags = np.bincount(of_word * BUCKETS + hashes % BUCKETS, minlength=passages * BUCKETS).reshape(passages, BUCKETS) / per[:, None]
    rest = np.stack([mean / 10, spread / 10, distinct, again, capitals, np.log1p(per) / 5], axis=1)
    return np.concatenate([shares * 4, rest, bags * 4], axis=1).astype(np.float32)


@dataclass
class MilModel:
    """Weights of encoder (W, b), gated attention (V, U, w) and score (c, d), with the features' centre and scale."""

    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6, 6)

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Bags are rows of x from each start on to the next."""
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "bag": bag}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        return self.forward(self.standard(np.concatenate(bags)), starts)["y"]


def gradients(model: MilModel, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> dict[str, np.ndarray]:
    p, f = model.weights, model.forward(x, starts)
    dy = (f["y"] - labels) * balance / len(labels)
    dz = (dy[:, None] * p["c"])[f["bag"]]
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
    dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
    du = dh * (1 - f["h"] ** 2)
    return {
        "W": x.T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(),
    }


def fit_mil(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, steps: int = 2000, seed: int = 0) -> MilModel:
    """Fit balanced cross-entropy with weight decay by `steps` steps of Adam, or one epoch if that is more, on batches of
    some 64 bags. Without both labels, the score is the labels' mean."""
    random = np.random.default_rng(seed)
    everything = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    shape = {"W": (FEATURES, hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "w": (attention,), "c": (hidden,), "d": ()}
    weights = {k: random.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for k, s in shape.items()}
    weights["w"], weights["c"] = random.normal(0, 0.3, attention), random.normal(0, 0.3, hidden)
    model = MilModel(everything.mean(axis=0, dtype=np.float64), everything.std(axis=0, dtype=np.float64) + 1e-3, weights)
    positive = float(labels.mean()) if len(labels) else 0.5
    if positive in (0.0, 1.0) or not len(labels):
        weights["c"][:] = 0
        weights["d"] = np.float64(np.log((positive + 1e-3) / (1 - positive + 1e-3)))
        return model
    balance = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    bags = [model.standard(b).astype(np.float64) for b in bags]
    mean, square, step = {k: 0.0 for k in weights}, {k: 0.0 for k in weights}, 0
    parts = max(1, len(bags) // 64)
    epochs = -(-steps // parts)
    for epoch in range(epochs):
        for part in np.array_split(random.permutation(len(bags)), parts):
            own = [bags[i] for i in part]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in own])[:-1]]).astype(np.int64)
            step += 1
            for k, g in gradients(model, np.concatenate(own), starts, labels[part], balance[part]).items():
                g = g + 1e-3 * weights[k] if k in "WVU" else g
                mean[k], square[k] = 0.9 * mean[k] + 0.1 * g, 0.999 * square[k] + 0.001 * g * g
                rate = 0.01 * 0.5 ** (4 * epoch / epochs)
                weights[k] = weights[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 3000, most_passages: int = 2000) -> MilModel:
    """Fit on the `sample` labelled ids of least hash that aren't held out, without texts of over most_passages passages.

    Both bounds hold what reaches the driver: passage features of the sample, no texts. Only labels 0 and 1 with an id
    take part; where labels repeat an id, its least label counts, and where documents do, one row of it.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label")).filter(~held_out())
    ids = marked.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample)
    rows = bound_batches(documents).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # `sample` ids at most, so that no text is shuffled
    chosen = rows.filter(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) <= most_passages * PASSAGE)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [encode_passages(t).astype(np.float16).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype(str), "label": batch["label"], "bag": bags})

    encoded = chosen.mapInPandas(run, "doc_id string, label int, bag binary")
    found = encoded.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bag").alias("bag")).toPandas().sort_values("doc_id")
    bags = [np.frombuffer(b, np.float16).astype(np.float32).reshape(-1, FEATURES) for b in found["bag"]]
    return fit_mil(bags, found["label"].to_numpy(np.float64))


def score_texts(text: Column, model: MilModel) -> Column:
    """How likely the text's label is 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scores, bags, size = [np.zeros(0)], [], 0
        for t in texts:
            bags.append(encode_passages(t))
            size += len(bags[-1])
            if size > 4096:
                scores.append(model.scores(bags))
                bags, size = [], 0
        if bags:
            scores.append(model.scores(bags))
        return pd.Series(np.concatenate(scores))

    return score(text)


def classify_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The model sees nothing but the text. Null and empty texts are one passage of zeros and get its score; a null id
    is not held out and has no label. Rows that repeat an id are scored each by its own text. Without labels, all
    scores are 0.5.
    """
    score = score_texts(F.col("text"), train(documents, labels, **options))
    rows = documents.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return rows.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents of score `threshold` or more, with their columns; one pass over the texts, no shuffle."""
    return documents.filter(score_texts(F.col("text"), train(documents, labels, **options)) >= threshold)
