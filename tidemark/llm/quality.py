"""A quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes are embedded; learned filters slide
over each chunk; their activations are max-pooled by chunk. The mean and the maximum over the chunks' features go into a
logistic unit that gives one probability. The network is trained on the driver, by Adam, on at most ``train_rows``
labelled documents (a documented bound; the choice is by a hash of the id); scoring reads every document whole, in
batches of chunks of bounded size. Defined results:

* ids are integers; a null or empty text has probability 0; texts may be of any length; repeated rows are scored each;
* labelled rows without a text or a label, or with an id that no document has, are not trained on;
* with no labels, or only one kind, the probability is the share of good labels (0.5 with none) for every text;
* an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .tokens import raw

TRAIN_ROWS = 4000
KEEP = 0.3
CHUNK, OVERLAP = 256, 32
WIDTH, STRIDE = 8, 4
DIM, FILTERS = 6, 24
EPOCHS, BATCH, RATE = 8, 32, 0.004
SCORES = "doc_id bigint, probability double, keep boolean"


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "embed": f(257, DIM, scale=0.5), "filter": f(WIDTH * DIM, FILTERS, scale=0.25), "bias": np.zeros(FILTERS, np.float32),
            "out": f(2 * FILTERS, scale=0.1), "shift": np.zeros(1, np.float32),
        }
        self.w["embed"][256] = 0  # past the end
        self.constant: float | None = None

    # -- forward

    @staticmethod
    def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of overlapping chunks, 256 past a document's end, and each chunk's document. Every byte is in one."""
        lengths = np.diff(offs)
        step = CHUNK - OVERLAP
        counts = np.where(lengths > 0, np.maximum(1, -(-(lengths - OVERLAP) // step)), 0)
        doc = np.repeat(np.arange(len(lengths)), counts)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
        index = start[:, None] + np.arange(CHUNK)
        inside = index < lengths[doc][:, None]
        index += offs[doc][:, None]
        values = data[np.minimum(index, max(0, len(data) - 1))].astype(np.int16) if len(data) else np.zeros(index.shape, np.int16)
        values[~inside] = 256
        return values, doc

    def features(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max-pooled activations of each chunk, where each filter's maximum is, and the windows' inputs."""
        embedded = self.w["embed"][values]  # chunks, bytes, dim
        windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
        flat = np.ascontiguousarray(windows).reshape(len(values), windows.shape[1], WIDTH * DIM)
        active = flat @ self.w["filter"]
        where = active.argmax(1)
        top = np.take_along_axis(active, where[:, None], 1)[:, 0] + self.w["bias"]
        return np.maximum(top, 0), where, flat

    @staticmethod
    def combine(top: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and maximum of the chunks' features by document; doc is ascending."""
        present, first = np.unique(doc, return_index=True)
        total, most = np.zeros((n, FILTERS), top.dtype), np.zeros((n, FILTERS), top.dtype)
        if len(present):
            total[present] = np.add.reduceat(top, first)
            most[present] = np.maximum.reduceat(top, first)
        count = np.maximum(np.bincount(doc, minlength=n), 1).astype(top.dtype)[:, None]
        return np.concatenate([total / count, most], 1), count

    def scores(self, data: np.ndarray, offs: np.ndarray, tile: int = 512) -> np.ndarray:
        """The probability of each document."""
        n = len(offs) - 1
        if self.constant is not None:
            out = np.full(n, self.constant)
        else:
            values, doc = self.chunks(data, offs)
            top = np.concatenate([np.zeros((0, FILTERS), np.float32), *(self.features(values[k : k + tile])[0] for k in range(0, len(values), tile))])
            x, _ = self.combine(top, doc, n)
            out = _sigmoid((x @ self.w["out"] + self.w["shift"]).astype(np.float64))
        out[np.diff(offs) == 0] = 0
        return out

    # -- training

    def gradient(self, values: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n = len(y)
        top, where, flat = self.features(values)
        x, count = self.combine(top, doc, n)
        error = (_sigmoid(x @ self.w["out"] + self.w["shift"]) - y).astype(np.float32) / n
        g = {"out": x.T @ error, "shift": error.sum(keepdims=True)}
        dx = error[:, None] * self.w["out"]
        dtop = (dx[:, :FILTERS] / count)[doc] + np.where(top == x[doc, FILTERS:], dx[doc, FILTERS:], 0)
        dtop *= top > 0
        rows = np.arange(len(values))[:, None]
        inputs = flat[rows, where]  # the window that gave each maximum: chunks, filters, width * dim
        g["bias"] = dtop.sum(0)
        g["filter"] = np.einsum("cfi,cf->if", inputs, dtop, optimize=True)
        back = (dtop[:, :, None] * self.w["filter"].T[None]).reshape(len(values), FILTERS, WIDTH, DIM)
        at = values[rows[:, :, None], (where * STRIDE)[:, :, None] + np.arange(WIDTH)]
        g["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(g["embed"], at.ravel(), back.reshape(-1, DIM))
        g["embed"][256] = 0
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        y = np.asarray(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.w["shift"][0] = np.log(y.mean() / (1 - y.mean()))
        rng, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                own = [np.frombuffer(texts[i], np.uint8) for i in pick]
                values, doc = self.chunks(np.concatenate(own), np.concatenate([[0], np.cumsum([len(o) for o in own])]))
                t += 1
                rate = RATE * (1 - epoch / epochs)
                for name, g in self.gradient(values, doc, y[pick]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.99 * v[name] + 0.01 * g * g
                    self.w[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-7)
        return self


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``rows`` labelled documents, chosen by a hash of their id: the hash picks ids before any text is read."""
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64("id"), "y").limit(rows)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") > 0)
    return own.join(F.broadcast(picked), "id").select("id", "text", "y")  # at most ``rows`` rows are broadcast


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, **columns: str) -> Network:
    sample = training_rows(docs, labels, rows, **columns).toArrow().sort_by([("id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return Network().fit([t.encode() for t in sample.column("text").to_pylist()], sample.column("y").to_numpy())


def _score(network: Network, keep: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            p = network.scores(*raw(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), p, p >= keep], names=["doc_id", "probability", "keep"])

    return task


def classify(docs: DataFrame, network: Network, keep: float = KEEP, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's probability of good quality, and whether it reaches ``keep``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score(network, keep), SCORES)
