"""Token counts by section: a document is encoded once, as a whole, and its tokens are given to its sections.

The tokens of a byte-level vocabulary are pieces of the text's bytes, so the
running sum of their lengths is each token's span. Sections are the lines of
the text, a line holding the line feed that ends it, or spans of characters
that the caller gives in a column, such as fields of a page. Spans and sections
are both in order, so the interval join is a search.

The rule for a token that crosses a boundary: it goes to the section that holds
most of its bytes, and of equal shares to the first; what lies between sections
is a section of its own for this rule, whose tokens are counted as outside.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.llm.tables import in_batches

#: How the text is cut before merging; the public pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks for tiktoken: lines of a base64 piece and its rank."""
    if not path or not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary of ranks at {path!r}; its path is a setting of the caller")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def encoder(ranks: dict[bytes, int]):
    """The encoding, and the length in bytes of each token."""
    import tiktoken

    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths[ids])
    return ends - lengths[ids], ends


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which lines begin; an empty text has one empty line."""
    feeds = np.flatnonzero(data == 0x0A) + 1
    return np.concatenate(([0], feeds[feeds < len(data)]))


def allocate(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, which begin at ``sections`` and follow one another, and the number of tokens that cross a boundary."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    own = first.copy()
    crossing = np.flatnonzero(last > first)
    bounds = np.append(sections, np.iinfo(np.int64).max)
    for i in crossing.tolist():
        parts = np.arange(first[i], last[i] + 1)
        held = np.minimum(bounds[parts + 1], ends[i]) - np.maximum(bounds[parts], starts[i])
        own[i] = parts[held.argmax()]
    return np.bincount(own, minlength=len(sections)), len(crossing)


def character_bounds(data: np.ndarray) -> np.ndarray:
    """The byte offset of each character, and of the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def spans_to_cuts(bounds: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the text is cut so that each span is a piece, and the pieces that are spans. Spans are in characters, in order and apart; one beyond the text ends with it."""
    cuts, own = [0], []
    for start, stop in spans:
        a, b = (int(bounds[min(max(x, 0), len(bounds) - 1)]) for x in (start, max(start, stop)))
        if a < cuts[-1]:
            raise ValueError("spans of sections overlap or are out of order")
        if a > cuts[-1]:
            cuts.append(a)
        own.append(len(cuts) - 1)
        cuts.append(b)
    return np.array(cuts, np.int64), np.array(own, np.int64)


def token_counts(docs: DataFrame, vocabulary: str, sections: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, n_sections, n_crossing, and section_tokens with the tokens of each section in order.

    Without ``sections`` these are the lines, whose tokens add up to n_tokens;
    a null or empty text has one empty line without tokens. ``sections`` names
    a column of array<struct<start, stop>>, characters from 0, in order and
    apart; a null array has no sections, and tokens outside of all are in
    n_tokens alone. Rows that repeat give a row each.
    """
    spans = F.transform(F.col(sections), lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))) if sections else F.lit(None).cast("array<struct<start: bigint, stop: bigint>>")
    rows = in_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"), spans.alias("spans"))
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens", "n_sections", "n_crossing")), T.StructField("section_tokens", T.ArrayType(T.LongType()))]
    )
    # the vocabulary's size is fixed; it is read here and sent, as executors may lack the file
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(shared.value)
        for batch in batches:
            out = []
            for value, given in zip(batch.column(1), batch.column(2), strict=True):
                text = value.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
                if sections:
                    cuts, own = spans_to_cuts(character_bounds(data), [(s["start"], s["stop"]) for s in given.as_py() or ()])
                else:
                    cuts = line_starts(data)
                    own = np.arange(len(cuts))
                held, crossing = allocate(*token_spans(ids, lengths), cuts)
                out.append((len(data), len(ids), len(own), crossing, held[own]))
            cols = [pa.array([r[j] for r in out], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([r[4] for r in out], pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(count, schema)
