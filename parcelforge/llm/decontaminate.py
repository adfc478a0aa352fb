"""Benchmark decontamination with a positional inverted index.

The index is a table of segments. A segment holds the postings of some whole
documents: the sorted term hashes, where each term's list begins, and the
lists of positions. A document lies in one segment, so lists meet without a
shuffle; positions of different documents are one apart at least, so no phrase
crosses documents.

A query window is found by taking the list of its rarest term in the segment,
moving it by the term's offset in the window, and intersecting it with the
moved lists of the next rarer terms until it is empty or all terms agree.

Benchmark items go to the tasks in blocks of about ``block_words`` words, longer
items in overlapping pieces; a larger benchmark takes several passes over the
index, one block in memory at a time, whose spans are merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.llm.tables import discard, in_batches, materialize, maybe_broadcast, private
from parcelforge.llm.words import blocks, buffers, word_hashes

SEGMENT_BYTES = 2 << 20
#: Words of benchmark items that one pass over the index may carry to each task (8 bytes a word and window place).
BLOCK_WORDS = 200_000
#: Ids of contaminated documents that may be sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Moved positions that are intersected at once.
CANDIDATES = 1 << 18


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.BinaryType()),
            T.StructField("begins", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
        ]
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Tokenise ``docs`` and store the postings of every term.

    A null text has no words. Every row gets a place of its own, whether or not
    its id repeats or is null. Other columns are not read.
    """
    frame = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = _index_schema(frame.schema["id"].dataType)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in blocks(offsets, segment_bytes):
                hashes, rows = [], [np.zeros(1, np.int64)]
                for c, d in blocks(offsets[a : b + 1] - offsets[a]):
                    own = offsets[a + c : a + d + 1]
                    h, r = word_hashes(data[own[0] : own[-1]], own - own[0], "alnum")
                    hashes.append(h)
                    rows.append(r[1:] + rows[-1][-1])
                hashes, rows = np.concatenate(hashes), np.concatenate(rows)
                n = np.diff(rows)
                # one free position after each document
                at = np.arange(len(hashes), dtype=np.int32) + np.repeat(np.arange(len(n), dtype=np.int32), n)
                order = np.argsort(hashes, kind="stable")
                hashes = hashes[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1])))
                begins = np.append(first, len(hashes)).astype(np.int32)
                positions = np.diff(at[order], prepend=np.int32(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}-{number}"]),
                        pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.schema.field(0).type)),
                        pa.array([n.tolist()], pa.list_(pa.int64())),
                        pa.array([hashes[first].tobytes()], pa.binary()),
                        pa.array([begins.tobytes()], pa.binary()),
                        pa.array([positions.tobytes()], pa.binary()),
                    ],
                    names=schema.names,
                )
                number += 1

    return materialize(frame.mapInArrow(segments, schema), "postings", "zstd")


class Segment:
    """Postings of one segment; ``keys`` are all (term, position) pairs as sorted integers."""

    def __init__(self, n_words: list[int], terms: bytes, begins: bytes, positions: bytes):
        self.n_words = np.asarray(n_words, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.n_words + 1)))  # position of each document's first word
        self.span = int(self.first[-1]) + 1
        self.terms = np.frombuffer(terms, np.uint64)
        self.begins = np.frombuffer(begins, np.int32).astype(np.int64)
        self.positions = np.cumsum(np.frombuffer(positions, np.int32), dtype=np.int32).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.begins)) * self.span + self.positions

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term number of each hash, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(hashes.shape, -1, np.int64)
        i = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[i] == hashes, i, -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.span + position
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[i] == key) & (position >= 0)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every exact occurrence of the windows, each a row of term hashes."""
        none = np.zeros(0, np.int64)
        terms = self.lookup(windows)
        alive = np.flatnonzero((terms >= 0).all(1)) if terms.size else none
        if not len(alive):
            return none, none
        terms = terms[alive]
        counts = self.begins[terms + 1] - self.begins[terms]
        rarest = np.argsort(counts, axis=1, kind="stable")
        found_w, found_s = [], []
        load = np.cumsum(np.take_along_axis(counts, rarest[:, :1], 1)[:, 0])
        a = 0
        while a < len(alive):
            done = load[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(load, done + CANDIDATES, "right")))
            rows = np.arange(a, b)
            place = rarest[rows, 0]
            n = counts[rows, place]
            w = np.repeat(rows, n)
            from_ = np.repeat(self.begins[terms[rows, place]], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[from_] - np.repeat(place, n)
            for k in range(1, terms.shape[1]):
                if not len(w):
                    break
                place = rarest[w, k]
                ok = self.has(terms[w, place], start + place)
                w, start = w[ok], start[ok]
            keep = start >= 0
            found_w.append(alive[w[keep]])
            found_s.append(start[keep])
            a = b
        return np.concatenate(found_w), np.concatenate(found_s)

    def near(self, terms: np.ndarray, width: int) -> np.ndarray:
        """Positions of the rarest of ``terms`` (distinct hashes) around which all of them lie within ``width`` words of one document."""
        t = self.lookup(terms)
        if not len(t) or (t < 0).any():
            return np.zeros(0, np.int64)
        t = t[np.argsort(self.begins[t + 1] - self.begins[t], kind="stable")]
        at = self.positions[self.begins[t[0]] : self.begins[t[0] + 1]]
        doc = np.searchsorted(self.first, at, "right") - 1
        low, high = self.first[doc], self.first[doc] + self.n_words[doc]
        starts = at[:, None] - np.arange(width)[None, :]
        ok = starts >= low[:, None]
        for one in t[1:]:
            left = np.searchsorted(self.keys, one * self.span + np.maximum(starts, 0))
            right = np.searchsorted(self.keys, one * self.span + np.minimum(starts + width, high[:, None]))
            ok &= right > left
        return at[ok.any(1)]


def query_windows(items: list[tuple[str, list[int]]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, list[str]]]:
    """By window length: the windows' term hashes, the item number of each, and the items' ids. An item of fewer than ``size`` words is one window."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    by_length: dict[int, set] = defaultdict(set)
    for name, words in items:
        length = min(size, len(words))
        for j in range(len(words) - length + 1) if length else ():
            by_length[length].add((number[name], *words[j : j + length]))
    out = {}
    for length, rows in by_length.items():
        both = sorted(rows)
        out[length] = (np.array([r[1:] for r in both], np.int64).view(np.uint64), np.array([r[0] for r in both], np.int64), names)
    return out


def _hashed_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A shared table of (id, words): the items with an id and a text, their words as hashes."""
    frame = in_batches(benchmark).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, rows = word_hashes(*buffers(batch.column(1)), "alnum")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(h.view(np.int64)))], names=["id", "words"])

    return materialize(frame.mapInArrow(hashed, "id string, words array<long>"), "items")


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[int]]]]:
    """The rows of ``items`` in blocks of about ``block_words`` words, one block at a time on the driver."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = -(-total // block_words) or 1
    for part in range(parts):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("id", "words"), F.lit(parts)) == part).toLocalIterator()]


def _in_pieces(items: DataFrame, window: int, piece_words: int) -> DataFrame:
    """``items`` with longer ones cut into pieces that overlap by ``window`` - 1 words, so each window is in one of them."""
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece_words))
    pieces = F.transform(begins, lambda b: F.slice("words", b + 1, F.lit(piece_words + window - 1)))
    return items.select("id", F.explode(pieces).alias("words"))


def phrase_matches(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Exact matches of the items' windows: one row per indexed document with ``id``, ``n_words``, ``spans`` (word ranges that windows cover, disjoint, in order) and ``items`` (ids as strings).

    Items without id or words match nothing; items that repeat count once.
    """
    spark = in_batches(index).sparkSession
    out_schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("place", T.IntegerType()),
            T.StructField("id", index.schema["ids"].dataType.elementType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def searching(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    name, ids, n_words, terms, begins, positions = (batch.column(k)[row] for k in range(6))
                    n_words = n_words.as_py()
                    seg = Segment(n_words, terms.as_py(), begins.as_py(), positions.as_py())
                    covered = np.zeros(seg.span + 1, np.int32)
                    items: dict[int, set[str]] = defaultdict(set)
                    for length, (windows, owner, names) in shared.value.items():
                        w, start = seg.phrases(windows)
                        np.add.at(covered, start, 1)
                        np.add.at(covered, start + length, -1)
                        doc = np.searchsorted(seg.first, start, "right") - 1
                        for d, i in np.unique(np.stack([doc, owner[w]]), axis=1).T.tolist() if len(w) else ():
                            items[d].add(names[i])
                    on = np.cumsum(covered) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
                    spans: dict[int, list] = defaultdict(list)
                    for s, e in edge.reshape(-1, 2).tolist():
                        d = int(np.searchsorted(seg.first, s, "right")) - 1
                        spans[d].append({"start": s - int(seg.first[d]), "stop": e - int(seg.first[d])})
                    n = len(n_words)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.as_py()] * n, pa.string()),
                            pa.array(range(n), pa.int32()),
                            ids.values,
                            pa.array(n_words, pa.int64()),
                            pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                            pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                        ],
                        names=out_schema.names,
                    )

        return search

    items = materialize(_in_pieces(_hashed_items(benchmark, id_col, text_col), window, max(1, block_words // 8)), "pieces")
    every, held = None, None
    for block in _blocks(items, block_words):
        if held is not None:
            # a pass is written before the next block is sent, and its block is forgotten
            every = materialize(one, "spans") if every is None else every.unionByName(materialize(one.where("size(spans) > 0"), "spans"))
            held.destroy()
        held = spark.sparkContext.broadcast(query_windows(block, window))
        one = index.mapInArrow(searching(held), out_schema)
    if every is None:
        return one.drop("segment", "place")
    every = every.unionByName(materialize(one.where("size(spans) > 0"), "spans"))
    held.destroy()
    merged = every.groupBy("segment", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    disjoint = """aggregate(raw, cast(array() as array<struct<start: bigint, stop: bigint>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).stop >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop)))),
           concat(acc, array(x))))"""
    return merged.select("id", "n_words", F.expr(disjoint).alias("spans"), "items")


def proximity_matches(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 50, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item, position): documents with all distinct words of an item within ``width`` consecutive words, in any order; ``position`` is the word number of the item's rarest word there."""
    spark = in_batches(index).sparkSession
    out_schema = T.StructType([T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("item", T.StringType()), T.StructField("position", T.LongType())])

    def searching(shared):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    _, ids, n_words, terms, begins, positions = (batch.column(k)[row].as_py() for k in range(6))
                    seg, found = Segment(n_words, terms, begins, positions), []
                    for item, words in shared.value:
                        for p in seg.near(np.unique(np.array(words, np.int64).view(np.uint64)), width).tolist():
                            d = int(np.searchsorted(seg.first, p, "right")) - 1
                            found.append((ids[d], item, p - int(seg.first[d])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f[0] for f in found], batch.schema.field(1).type.value_type), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], names=out_schema.names
                    )

        return search

    out = spark.createDataFrame([], out_schema)
    for items in _blocks(_hashed_items(benchmark, id_col, text_col), block_words):
        held = spark.sparkContext.broadcast(items)
        out = out.unionByName(materialize(index.mapInArrow(searching(held), out_schema), "near"))
        held.destroy()
    return out.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated.

    Null, empty or wordless texts have no words and are clean; an empty
    benchmark leaves all clean; rows that repeat give a row each.
    """
    return _judged(phrase_matches(build_index(docs), benchmark, window=window, block_words=block_words))


def _judged(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark passage, with their columns. Rows that share a doc_id go together; null and empty texts stay, and all documents where the benchmark is empty."""
    (bad_id,) = private(docs, "bad_id")
    index = build_index(docs)
    bad = materialize(_judged(phrase_matches(index, benchmark, window=window)).where("contaminated").select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    discard(index)
    return docs.join(maybe_broadcast(bad, BROADCAST_IDS), docs["doc_id"].eqNullSafe(bad[bad_id]), "left_anti")
