"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A sketch has t coordinates. In round i < t each shingle is put in the bin that
the round's hash names, with the value (i, random); in round t + j all go to
bin j. A bin keeps its smallest value, and rounds end when all bins are full,
so after 2t rounds at the latest each coordinate is filled and two sketches
agree in a coordinate with the sets' Jaccard similarity, with the
concentration of independent samples.

Bands of ``ROWS`` coordinates are hashed; documents that share a band are
compared. Documents with the same set are one representative beforehand. In a
bucket every member is compared with its hub, the member that shares most
buckets with most others: the original of a group of edited copies is nearer to
each of them than they are to one another.

Members that these links leave outside the hub's component must still be
compared with the others. For that each member keeps its edits, the shingles
that it and the hub do not share; two members differ in the edits that only one
of them has, so their similarity follows from the number of edits they share.
Left members are compared with their hub's whole group in blocks, and only
links come out, one for each other component. So each two members of a bucket
are in one component or compared, and no pairs are written.

With 6 rows and 48 bands a pair at similarity 0.8 shares no band with a chance
of 5e-7; at 0.9 less than 1e-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.tables import discard, in_batches, materialize, maybe_broadcast, private
from parcelforge.llm.words import blocks, buffers, shingle_hashes, splitmix, word_hashes

ROWS, BANDS = 6, 48
#: Ids of documents to compare (8 bytes each) that may be sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Edits and members of a block in which left members are compared.
BLOCK_EDITS, BLOCK_ROWS = 200_000, 1000


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t values for each non-empty set of hashes."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full(n * t, np.uint64((1 << 64) - 1))
    items, row = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n, dtype=np.int64) * t, sizes)
    for i in range(2 * t):
        if not len(items):
            break
        h = splitmix(items ^ splitmix(np.array([i], np.uint64)))
        bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        value = (np.uint64(i) << np.uint64(44)) | (splitmix(h) >> np.uint64(20))
        np.minimum.at(out, row + bins, value)
        open_ = (out.reshape(n, t) >> np.uint64(63)).any(1)
        if not open_.all():
            keep = open_[row // t]
            items, row = items[keep], row[keep]
    return out.reshape(n, t)


def band_hashes(sketch: np.ndarray, rows: int, bands: int) -> np.ndarray:
    h = np.zeros((len(sketch), bands), np.uint64) + splitmix(np.arange(bands, dtype=np.uint64))
    part = sketch.reshape(len(sketch), bands, rows)
    for j in range(rows):
        h = splitmix(h ^ part[:, :, j])
    return h


def _sketch_table(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    text = F.col("text").cast("string")
    frame = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))

    def sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for a, b in blocks(offsets):
                own = offsets[a : b + 1]
                sets = shingle_hashes(*word_hashes(data[own[0] : own[-1]], own - own[0], "nonspace"), k)
                full = [s for s in sets if len(s)]
                bands_of = iter(band_hashes(sketches(full, rows * bands), rows, bands).view(np.int64))
                sums = [(len(s), int(s.sum(dtype=np.uint64).view(np.int64)), int(splitmix(s).sum(dtype=np.uint64).view(np.int64)), next(bands_of) if len(s) else None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array([x[j] for x in sums], pa.int64()) for j in range(3)), pa.array([x[3] for x in sums], pa.list_(pa.int64()))],
                    names=["doc_id", "copy", "n_shingles", "set_a", "set_b", "bands"],
                )

    return materialize(frame.mapInArrow(sketching, "doc_id long, copy long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketches")


def _verify(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (hub, hub_copy, rep, rep_copy, wide) with the sizes of the sets, hub_n and n, and of what they share, common, from the whole texts; for wide pairs ``edits``, the shingles of either alone.

    Each member's text goes to its hub, whose own text is read once for all of
    a task's members; a hub of many members is split by the skewed join.
    """
    ids = materialize(pairs.select(F.explode(F.array(F.struct(F.col("hub").alias("id"), F.col("hub_copy").alias("copy")), F.struct(F.col("rep").alias("id"), F.col("rep_copy").alias("copy")))).alias("x")).select("x.*").distinct(), "ids")
    text = F.col("text").cast("string")
    # rows of one id and hash are one text
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text")).join(maybe_broadcast(ids, BROADCAST_IDS), ["id", "copy"], "left_semi").groupBy("id", "copy").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    side = lambda who, name: texts.select(F.col("id").alias(who), F.col("copy").alias(f"{who}_copy"), F.col("text").alias(name)).hint("merge")
    both = pairs.join(side("rep", "other"), ["rep", "rep_copy"]).join(side("hub", "one"), ["hub", "hub_copy"])
    names = ["hub", "hub_copy", "rep", "rep_copy", "wide"]

    def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [buffers(batch.column(j)) for j in (5, 6)]
            wide = batch.column(4).to_pylist()
            for a, b in blocks(cols[0][1] + cols[1][1]):
                sides, out = [], []
                for data, offsets in cols:
                    own = offsets[a : b + 1]
                    sides.append(shingle_hashes(*word_hashes(data[own[0] : own[-1]], own - own[0], "nonspace"), k))
                for x, y, w in zip(*sides, wide[a:b], strict=True):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((len(x), len(y), n, np.setxor1d(x, y, assume_unique=True).view(np.int64) if w else None))
                figures = [pa.array([r[j] for r in out], pa.int64()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, b - a) for j in range(5)), *figures, pa.array([r[3] for r in out], pa.list_(pa.int64()))], names=[*names, "hub_n", "n", "common", "edits"])

    out = materialize(both.select(*names, "one", "other").mapInArrow(comparing, "hub long, hub_copy long, rep long, rep_copy long, wide boolean, hub_n long, n long, common long, edits array<long>"), "verified")
    discard(ids, texts)
    return out


def block_links(left: dict, group: dict, percent: int) -> list[tuple[int, int]]:
    """(rep of the one block, label in the other) where two members of one hub are near and their labels differ, once for each label."""
    (reps, n, labels, edits), (_, m, others, edits2) = ([side[c] for c in ("rep", "n", "label", "edits")] for side in (left, group))
    sizes, sizes2 = (np.array([len(e) for e in x], np.int64) for x in (edits, edits2))
    rows, rows2 = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes2)), sizes2)
    flat, flat2 = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in (edits, edits2))
    both = np.intersect1d(flat, flat2)
    shared = np.zeros((len(sizes), len(sizes2)), np.float32)
    if len(both):
        at, at2 = (np.minimum(np.searchsorted(both, f), len(both) - 1) for f in (flat, flat2))
        (rows, at), (rows2, at2) = ((r[both[i] == f], i[both[i] == f]) for r, i, f in ((rows, at, flat), (rows2, at2, flat2)))
        for low in range(0, len(both), 4096):
            width = min(4096, len(both) - low)
            x, y = np.zeros((len(sizes), width), np.float32), np.zeros((len(sizes2), width), np.float32)
            for matrix, r, i in ((x, rows, at), (y, rows2, at2)):
                here = (i >= low) & (i < low + width)
                matrix[r[here], i[here] - low] = 1
            shared += x @ y.T
    apart = sizes[:, None] + sizes2[None, :] - 2 * shared.astype(np.int64)
    common = (n[:, None] + m[None, :] - apart) // 2
    near = (100 * common >= percent * (common + apart)) & (labels[:, None] != others[None, :])
    return [(int(reps[i]), label) for i in np.flatnonzero(near.any(1)).tolist() for label in np.unique(others[near[i]]).tolist()]


def _cross_links(group: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of the members that are not in their hub's component, among ``group``: hub, hub_copy, rep, n, edits, label, left."""
    hub = ["hub", "hub_copy"]
    sizes = materialize(group.groupBy(*hub).agg(load_of(F.lit(True)).alias("parts"), load_of(F.col("left")).alias("left_parts"), F.max("left").alias("any")).where("any"), "loads")
    dealt = group.join(maybe_broadcast(sizes, BROADCAST_IDS), hub)
    row = F.struct("rep", "n", "label", "edits")
    deal = lambda parts: F.pmod(F.xxhash64("rep"), F.col(parts))
    one = dealt.where("left").groupBy(*hub, "parts", deal("left_parts").alias("left_part")).agg(F.collect_list(row).alias("one"))
    other = dealt.groupBy(*hub, deal("parts").alias("part")).agg(F.collect_list(row).alias("other"))
    # a block of left members goes to each block of its hub's group, so one hub is many tasks
    pairs = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(other, [*hub, "part"]).select("one", "other")

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows):
            *plain, lists = rows.flatten()
            fields = dict(zip(("rep", "n", "label"), plain, strict=True))
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            return {c: f.to_numpy(zero_copy_only=False) for c, f in fields.items()} | {"edits": [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]}

        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                one, other = (batch.column(j)[i].values for j in (0, 1))
                found += block_links(side(one), side(other), percent)
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(linking, "u long, v long").distinct()


def load_of(who):
    """Blocks for the rows of ``who``: so many edits and rows to a block, or one row."""
    return F.ceil(F.greatest(F.coalesce(F.sum(F.when(who, F.size("edits"))), F.lit(0)) / BLOCK_EDITS, F.count_if(who) / BLOCK_ROWS, F.lit(1.0)))


def components(links: DataFrame) -> DataFrame:
    """id and label of each end of the links (u, v): the smallest id reachable. Labels move along links and then jump to their own label; each round is a shared table."""
    edges = materialize(links.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        after = materialize(moved.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("label")), "labels")
        discard(labels)
        if after.where("label <> old").isEmpty():
            discard(edges)
            return after
        labels = after


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their
    sets of distinct k-word shingles. A document of fewer than k words is its
    whole sequence; one without words (null, empty, blank) has no set and is its
    own component. Rows that repeat a doc_id are one document: it is linked
    where any of its texts is, and its rows with words get one component. A
    null doc_id is never linked, has no component and is kept.
    """
    all_ = _sketch_table(docs, k, rows, bands)
    same = ["set_a", "set_b", "n_shingles"]
    reps = all_.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min(F.struct("doc_id", "copy")).alias("least"), F.first("bands").alias("bands"))
    reps = materialize(reps.select(*same, F.col("least.doc_id").alias("rep"), F.col("least.copy").alias("rep_copy"), "bands"), "representatives")
    rep = ["rep", "rep_copy"]
    banded = reps.select(*rep, F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    met = materialize(banded.join(crowded, "band"), "met")
    known_by = met.groupBy(*rep).agg(F.sum("members").alias("met"))
    counted = met.join(known_by, rep)
    hubs = counted.groupBy("band").agg(F.max(F.struct("met", (-F.col("rep")).alias("back"), F.col("rep_copy").alias("hub_copy"))).alias("most")).select("band", (-F.col("most.back")).alias("hub"), "most.hub_copy")
    members = materialize(met.join(hubs, "band"), "members")
    discard(met)
    sizes = reps.select(F.col("rep").alias("hub"), F.col("rep_copy").alias("hub_copy"), F.col("n_shingles").alias("hub_n"))
    pairs = members.where("rep <> hub or rep_copy <> hub_copy").groupBy("hub", "hub_copy", *rep, "n").agg((F.max("members") > 2).alias("wide")).join(sizes, ["hub", "hub_copy"])
    # pairs of too different sizes are no links, and their edits are needed in wide buckets only
    pairs = pairs.where(F.col("wide") | (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent))
    pairs = materialize(pairs.select("hub", "hub_copy", *rep, "wide"), "pairs")
    known = _verify(pairs, docs, k)
    discard(members, pairs)
    linked = F.col("common") * 100 >= (F.col("n") + F.col("hub_n") - F.col("common")) * percent
    links = known.where(linked).select(F.col("hub").alias("u"), F.col("rep").alias("v"))
    # ids with several texts, which are few, link the representatives of these
    several = all_.where("n_shingles > 0 and doc_id is not null").select("doc_id", *same, F.struct(*same).alias("s"))
    several = several.join(several.groupBy("doc_id").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low <> high").select("doc_id"), "doc_id", "left_semi")
    links = materialize(links.unionByName(several.join(reps.select(*same, "rep"), same).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))).where("u <> v"), "links")
    labels = components(links)

    label = lambda column, name: labels.select(F.col("id").alias(column), F.col("label").alias(name))
    group = known.where("wide").join(label("rep", "rep_label"), "rep", "left").join(label("hub", "hub_label"), "hub", "left")
    group = group.select("hub", "hub_copy", "rep", "n", "edits", F.coalesce("rep_label", "rep").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label"))
    more = materialize(_cross_links(group.withColumn("left", F.col("label") != F.col("hub_label")), percent), "cross-links")
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    discard(known, more, links)
    roots = reps.select(*same, "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select(*same, F.coalesce("label", "rep").alias("component"))
    out = all_.drop("bands", "copy").join(roots, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5) -> DataFrame:
    """The documents that are their component's smallest doc_id, with their columns; of rows that share a doc_id the one with the smallest text stays, null first, and all rows without one. Documents without words are copies of nothing and stay."""
    (gone_id,) = private(docs, "gone_id")
    gone = near_duplicates(docs, k).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("copies")).where("doc_id is not null and (not kept or copies > 1)")
    gone = materialize(gone.select(F.col("doc_id").alias(gone_id), "kept"), "gone")
    rest = docs.join(maybe_broadcast(gone.select(gone_id), BROADCAST_IDS), docs["doc_id"] == gone[gone_id], "left_anti")
    copies = gone.where("kept").select(gone_id)
    if copies.isEmpty():
        return rest
    again = docs.join(maybe_broadcast(copies, BROADCAST_IDS), docs["doc_id"] == copies[gone_id], "left_semi")
    plain = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no order and no hash
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*plain))).alias("row")).select("row.*")
    return rest.unionByName(first.select(*docs.columns))
