"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, each with a mark whether the last eight bytes repeat
those some 2 to 32 bytes earlier; so the alphabet has 513 symbols, padding
included. Overlapping chunks cover the whole text. Learned filters of eight
symbols run over a chunk, byte by byte, and each keeps its largest response; a document's
features are the mean and the maximum of its chunks' responses, and a logistic
layer makes one probability of them.

As the symbols are few, a filter is a table by place and symbol, the product of
symbol vectors and weights; the forward pass looks up and adds.

Training takes at most ``TRAIN_ROWS`` labelled rows in the order of a hash of
the id, which is the only bound; it and scoring read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.tables import in_batches, private
from parcelforge.llm.words import blocks, buffers

CHUNK, OVERLAP, WIDTH = 512, 8, 8
FILTERS, SYMBOL_DIMS = 16, 8
PADDING, SYMBOLS = 512, 513
LAGS = range(2, 33)
TRAIN_ROWS, EPOCHS, BATCH, SEED = 3000, 12, 64, 5
#: Chunks whose responses are held at once.
SCORE_CHUNKS = 256


def repeats(data: np.ndarray) -> np.ndarray:
    """Whether the eight bytes up to each one equal those a lag earlier, for any of the lags."""
    out = np.zeros(len(data), bool)
    for lag in LAGS:
        if len(data) < lag + 8:
            break
        same = data[lag:] == data[:-lag]
        for step in (1, 2, 4):
            same = same[step:] & same[:-step]
        out[lag + 7 :] |= same
    return out


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The symbols of all rows, and padding for a last chunk."""
    padded = np.full(len(data) + CHUNK, PADDING, np.uint16)
    padded[: len(data)] = data
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b > a:
            padded[a:b] += repeats(data[a:b]).astype(np.uint16) * np.uint16(256)
    return padded


def chunk_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each chunk begins and its row stops, one chunk at least for each row, and the n + 1 offsets of the rows among the chunks."""
    hop = CHUNK - OVERLAP
    counts = np.maximum(1, -(-np.maximum(np.diff(offsets) - OVERLAP, 1) // hop))
    first = np.concatenate(([0], np.cumsum(counts)))
    begin = np.repeat(offsets[:-1], counts) + (np.arange(first[-1]) - np.repeat(first[:-1], counts)) * hop
    return begin, np.repeat(offsets[1:], counts), first


def cut(padded: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    place = begin[:, None] + np.arange(CHUNK)[None, :]
    out = padded[np.minimum(place, len(padded) - 1)]
    out[place >= stop[:, None]] = PADDING
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all chunks of all rows, and the offsets of the rows among them."""
    begin, stop, first = chunk_places(offsets)
    return cut(symbols_of(data, offsets), begin, stop), first


def symbol_kinds() -> np.ndarray:
    """The symbols' vectors before training: lower-case letter, capital, digit, sign, white space, beyond ASCII, repeated, padding."""
    out = np.zeros((SYMBOLS, SYMBOL_DIMS), np.float32)
    for b in range(256):
        c = chr(b)
        kind = 5 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c.isspace() else 3
        out[[b, b + 256], kind] = 1
        out[b + 256, 6] = 1
    out[PADDING, 7] = 1
    return out


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {"E": symbol_kinds() + f32(SYMBOLS, SYMBOL_DIMS, s=0.05), "W": f32(WIDTH, SYMBOL_DIMS, FILTERS, s=0.25), "b": np.zeros(FILTERS, np.float32), "u": f32(2 * FILTERS, s=0.1), "c": np.zeros(1, np.float32)}

    def tables(self) -> np.ndarray:
        return np.einsum("sd,wdf->wsf", self.p["E"], self.p["W"]).astype(np.float32)

    def responses(self, symbols: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """(chunks, places, filters)"""
        last = CHUNK - WIDTH + 1
        out = tables[0].take(symbols[:, 0:last], axis=0)
        for j in range(1, WIDTH):
            out += tables[j].take(symbols[:, j : last + j], axis=0)
        return out

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        features = np.concatenate((np.add.reduceat(pooled, first[:-1]) / np.diff(first)[:, None], np.maximum.reduceat(pooled, first[:-1])), axis=1)
        return 1 / (1 + np.exp(-(features.astype(np.float64) @ self.p["u"] + self.p["c"][0])))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        padded, tables = symbols_of(data, offsets), self.tables()
        begin, stop, first = chunk_places(offsets)
        # some chunks at a time, so a long text takes two bytes for each of its own
        parts = [self.responses(cut(padded, begin[a : a + SCORE_CHUNKS], stop[a : a + SCORE_CHUNKS]), tables).max(1) for a in range(0, len(begin), SCORE_CHUNKS)]
        return self.combine(np.tanh(np.concatenate(parts) + self.p["b"]), first)

    def gradients(self, symbols: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, tables = self.p, self.tables()
        found = []
        for a in range(0, len(symbols), SCORE_CHUNKS):
            raw = self.responses(symbols[a : a + SCORE_CHUNKS], tables)
            at = raw.argmax(1)
            found.append((at, np.take_along_axis(raw, at[:, None, :], 1)[:, 0]))
        best = np.concatenate([x for x, _ in found])
        m = np.tanh(np.concatenate([x for _, x in found]) + p["b"])
        counts = np.diff(first)
        mean, top = np.add.reduceat(m, first[:-1]) / counts[:, None], np.maximum.reduceat(m, first[:-1])
        features = np.concatenate((mean, top), axis=1)
        prob = 1 / (1 + np.exp(-(features @ p["u"] + p["c"][0])))
        d = ((prob - labels) / len(labels)).astype(np.float32)
        g = {"u": features.T @ d, "c": np.array([d.sum()], np.float32)}
        df = d[:, None] * p["u"][None, :]
        row = np.repeat(np.arange(len(counts)), counts)
        dm = df[row, :FILTERS] / counts[row][:, None] + df[row, FILTERS:] * (m == top[row])
        dr = (dm * (1 - m * m)).astype(np.float32)
        g["b"] = dr.sum(0)
        g["E"], g["W"] = np.zeros_like(p["E"]), np.zeros_like(p["W"])
        cols = np.broadcast_to(np.arange(FILTERS), best.shape)
        for j in range(WIDTH):
            t = np.zeros((SYMBOLS, FILTERS), np.float32)
            np.add.at(t, (np.take_along_axis(symbols, best + j, 1), cols), dr)
            g["W"][j] = p["E"].T @ t
            g["E"] += t @ p["W"][j].T
        return g

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01) -> Network:
        """rows: the chunks of each document, at least one."""
        rng, step = np.random.default_rng(SEED), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                symbols = np.concatenate([rows[i] for i in part])
                first = np.concatenate(([0], np.cumsum([len(rows[i]) for i in part])))
                step += 1
                for k, g in self.gradients(symbols, first, labels[part]).items():
                    g = g + np.float32(1e-4) * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(id, label) of at most ``most`` labelled rows that are not held out; ids with several labels count by the largest."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | None:
    """The network that is fitted to labels.quality, or None without labelled rows of both kinds."""
    ids = F.broadcast(training_ids(labels, "quality", train_rows))  # train_rows rows at most
    rows = in_batches(docs).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id").select("id", "label", "text")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            out = []
            for a, b in blocks(offsets):
                own = offsets[a : b + 1]
                symbols, first = chunks(data[own[0] : own[-1]], own - own[0])
                for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    out.append(symbols[x:y].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "chunks"])

    found = rows.mapInArrow(chunked, "id long, label int, chunks binary").toArrow().to_pydict()
    order = sorted(range(len(found["id"])), key=lambda i: (found["id"][i], found["chunks"][i]))
    y = np.array([found["label"][i] for i in order], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return Network().fit([np.frombuffer(found["chunks"][i], np.uint16).reshape(-1, CHUNK) for i in order], y)


def scored(docs: DataFrame, network: Network | None, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the probability of good quality of the whole text; null counts as empty, and without a network all score 0.5."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            parts = [np.zeros(0)]
            for a, b in blocks(offsets):
                own = offsets[a : b + 1]
                parts.append(network.score(data[own[0] : own[-1]], own - own[0]) if network else np.full(b - a, 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts), pa.float64())], names=schema.names)

    return in_batches(docs).mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; equal texts get equal scores."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns; all of them where the labels train no network (an empty table, or labels of one kind). A null text is scored as an empty one; rows that repeat stay or go together."""
    network = train(docs, labels)
    if network is None:
        return docs
    (name,) = private(docs, "score")
    return scored(docs, network, name).where(F.col(name) >= threshold).drop(name)
