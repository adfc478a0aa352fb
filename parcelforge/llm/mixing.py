"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong
to. Words flow from a pattern, whose k-th copy costs k - 1 a word (a convex
cost), to the quotas of its sources. The cheapest largest flow says how many
words each pattern gives. Its whole copies go to all documents; of the rest,
documents are taken in the order of a seeded hash while they fit, found by
narrowing the hash range ten bits a pass, and the gap is closed by the largest
documents that fit into it, one of a size, those with a copy less first.

The flow is solved on the driver, which holds a row for each pattern and no
document. Patterns that share no source, directly or through others, are
solved apart; one with sources of its own has a closed form.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.tables import in_batches, materialize, maybe_broadcast, private

SEED = 17
#: Closing documents (some dozen a pattern) that may be sent to every task; more are joined by a shuffle.
BROADCAST_CLOSERS = 1_000_000
#: Patterns (some 40 bytes each) that may be sent to every task; more are joined by a shuffle.
BROADCAST_PATTERNS = 100_000


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict[object, float]:
    """Shares of ``total`` by weight; none is above ``most`` times its size, the excess goes to the others by weight."""
    caps = {s: most * n for s, n in sizes.items()}
    targets, open_ = {}, list(sizes)
    while open_:
        rest, weight = total - sum(targets.values()), sum(weights[s] for s in open_)
        shares = {s: rest * weights[s] / weight for s in open_}
        above = [s for s in open_ if shares[s] > caps[s]]
        if not above:
            targets |= shares
            break
        targets |= {s: float(caps[s]) for s in above}
        open_ = [s for s in open_ if s not in targets]
    return targets


class Flow:
    """Largest flow by levels and blocked paths, without recursion; capacities may grow between runs, and what has been sent stays."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, u: int, v: int, room: int) -> int:
        for a, b, r in ((u, v, room), (v, u, 0)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, s: int, t: int) -> list[int] | None:
        level = [-1] * len(self.out)
        level[s], ring = 0, [s]
        while ring:
            further = []
            for u in ring:
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] and level[v] < 0:
                        level[v] = level[u] + 1
                        further.append(v)
            ring = further
        return level if level[t] >= 0 else None

    def run(self, s: int, t: int) -> None:
        while level := self._levels(s, t):
            tried, path, u = [0] * len(self.out), [], s
            while True:
                if u == t:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    # back to the first arc that is full
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.out[u]
                while tried[u] < len(arcs):
                    e = arcs[tried[u]]
                    if self.room[e] and level[self.to[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                if tried[u] < len(arcs):
                    path.append(arcs[tried[u]])
                    u = self.to[path[-1]]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break


def _cheapest(patterns: Sequence[tuple[tuple, int]], quotas: dict, repeats: int) -> list[int]:
    """Only copies cost, so a path costs what its first arc does: the cheapest largest flow is the largest one with one copy each, enlarged to two, and so on."""
    number = {s: i for i, s in enumerate(sorted({s for sources, _ in patterns for s in sources}, key=lambda s: (s is None, s or "")))}
    flow, first = Flow(2 + len(patterns) + len(number)), 2 + len(patterns)
    own = [flow.arc(0, 2 + i, 0) for i in range(len(patterns))]
    for i, (sources, size) in enumerate(patterns):
        for s in sources:
            flow.arc(2 + i, first + number[s], size * repeats)
    for s, i in number.items():
        flow.arc(first + i, 1, quotas[s])
    for _ in range(repeats):
        for e, (_, size) in zip(own, patterns, strict=True):
            flow.room[e] += size
        flow.run(0, 1)
    return [flow.room[e ^ 1] for e in own]


def route(patterns: Sequence[tuple[tuple, int]], quotas: dict, repeats: int) -> list[int]:
    """Words that each pattern (sources, size) gives to the quotas of its sources, each word ``repeats`` times at most and as seldom as can be."""
    root: dict = {s: s for s in quotas}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    known = [tuple(s for s in sources if s in quotas) for sources, _ in patterns]
    for sources in known:
        for s in sources[1:]:
            root[find(s)] = find(sources[0])
    apart: dict = defaultdict(list)
    for i, sources in enumerate(known):
        if sources:
            apart[find(sources[0])].append(i)
    given = [0] * len(patterns)
    for members in apart.values():
        if len(members) == 1:
            i = members[0]
            given[i] = min(repeats * patterns[i][1], sum(quotas[s] for s in known[i]))
        else:
            for i, g in zip(members, _cheapest([(known[i], patterns[i][1]) for i in members], quotas, repeats), strict=True):
                given[i] = g
    return given


def select(units: DataFrame, wanted: list[tuple[str, int, int]], repeats: int, wide: DataFrame | None = None) -> DataFrame:
    """``wide``, or else ``units`` (doc_id, pattern, size, hash of 60 bits), with ``taken``. wanted: pattern, copies that all documents give, words that are taken besides; ``wide`` has the rows of ``units`` with more columns."""
    spark = in_batches(units).sparkSession
    few = lambda rows, schema: (F.broadcast if len(rows) <= BROADCAST_PATTERNS else lambda x: x)(spark.createDataFrame(rows, schema))
    state = [(p, 0, rest) for p, _, rest in wanted if rest > 0]
    limits: dict[str, int] = {}
    rests = {p: rest for p, _, rest in wanted}
    for level in range(6):
        if not state:
            break
        inside = units.join(few(state, "pattern string, prefix long, rest long"), "pattern").where(F.shiftright("hash", 60 - 10 * level) == F.col("prefix"))
        bins = inside.groupBy("pattern", "rest", F.shiftright("hash", 50 - 10 * level).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin"))  # 1,024 bins at most
        edge = bins.withColumn("upto", upto).where("upto > rest").groupBy("pattern").agg(F.min(F.struct("bin", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "docs")).alias("e"))
        rows = edge.select("pattern", "e.bin", "e.rest", "e.docs").collect()
        for r in rows:
            limits[r["pattern"]], rests[r["pattern"]] = r["bin"] << (50 - 10 * level), r["rest"]
        state = [(r["pattern"], r["bin"], r["rest"]) for r in rows if r["docs"] > 1]
    base = few([(p, copies, limits.get(p, 0)) for p, copies, _ in wanted], "pattern string, copies long, hash_limit long")
    deal = lambda rows: rows.join(base, "pattern", "left").withColumns({"copies": F.coalesce("copies", F.lit(0)), "hash_limit": F.coalesce("hash_limit", F.lit(0))})
    dealt = deal(units)
    gaps = [(p, rest) for p, rest in rests.items() if rest > 0]
    more = (F.col("copies") + F.when(F.col("hash") < F.col("hash_limit"), 1).otherwise(0)).alias("times")
    # rows of one hash are taken together; of those of one size the first hash stands for all
    spare = dealt.where("size > 0").join(few(gaps, "pattern string, rest long"), "pattern").withColumn("times", more).where(F.col("times") < repeats)
    sized = spare.groupBy("pattern", "rest", "times", "hash").agg(F.sum("size").alias("size")).where("size <= rest").groupBy("pattern", "rest", "times", "size").agg(F.min("hash").alias("hash"))

    def close(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        gap, picks = key[1].as_py(), []
        for _, size, h in sorted(zip(*(rows.column(c).to_pylist() for c in ("times", "size", "hash")), strict=True), key=lambda r: (r[0], -r[1])):
            if size <= gap:
                gap -= size
                picks.append(h)
        return pa.table({"pattern": pa.array([key[0].as_py()] * len(picks), pa.string()), "hash": pa.array(picks, pa.int64())})

    closers = materialize(sized.groupBy("pattern", "rest").applyInArrow(close, "pattern string, hash long"), "closers").withColumn("closer", F.lit(1))
    dealt = deal(units if wide is None else wide).join(maybe_broadcast(closers, BROADCAST_CLOSERS), ["pattern", "hash"], "left")
    times = F.col("copies") + F.when(F.col("hash") < F.col("hash_limit"), 1).otherwise(0) + F.coalesce("closer", F.lit(0))
    return dealt.withColumn("taken", F.col("size") * times).drop("copies", "hash_limit", "closer")


def mix(docs: DataFrame, weigh: Callable[[list], dict], share: float = 1.5, repeats: int = 2, seed: int = SEED, carry: Sequence[str] = ()) -> tuple[DataFrame, dict[object, int], dict[object, float]]:
    """Mix ``docs`` (doc_id, size, sources array) to targets of ``share`` times all words.

    ``weigh`` gives the weights of the sources, ordered by code point, null
    last. Returns doc_id, size, sources, taken and the columns ``carry``; each
    source's size and target. A document of several sources counts in the size
    of each.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 4)
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct("sources")).alias("s")))
    wide = docs.select("doc_id", "sources", F.col("size").cast("long").alias("size"), pattern.alias("pattern"), hashed.alias("hash"), *carry)
    units = materialize(wide.drop(*carry), "units")
    found = units.groupBy("pattern").agg(F.min("sources").alias("sources"), F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: r["pattern"])
    sizes: dict = {}
    for r in found:
        for s in set(r["sources"]):
            sizes[s] = sizes.get(s, 0) + r["size"]
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    total = sum(r["size"] for r in found)
    targets = water_fill(sizes, weigh(list(sizes)), share * total, repeats) if sizes else {}
    given = route([(tuple(sorted(set(r["sources"]), key=lambda s: (s is None, s or ""))), r["size"]) for r in found], {s: round(t) for s, t in targets.items()}, repeats)
    wanted = [(r["pattern"], *divmod(g, r["size"])) for r, g in zip(found, given, strict=True) if r["size"]]
    return select(units, wanted, repeats, wide if carry else None).select("doc_id", "size", "sources", "taken", *carry), sizes, targets


def turns_of_weights(sources: list, turn: Sequence[float] = (3, 1, 2)) -> dict:
    return {s: turn[i % len(turn)] for i, s in enumerate(sources)}


def _by_source(docs: DataFrame, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    units = docs.select("doc_id", words.alias("size"), F.array(F.col("source").cast("string")).alias("sources"), *row)
    mixed, sizes, targets = mix(units, turns_of_weights, seed=seed, carry=carry)
    figures = docs.sparkSession.createDataFrame([(s, n, targets[s]) for s, n in sizes.items()], "source string, source_size long, target double")
    figures = F.broadcast(figures) if len(sizes) <= BROADCAST_PATTERNS else figures
    mixed = mixed.withColumn("own", F.col("sources")[0])
    return mixed.join(figures, mixed["own"].eqNullSafe(figures["source"]), "left")


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; the size is the number of words, a null or blank text has none and is never taken. Empty tables give no rows; rows that repeat are taken together."""
    return _by_source(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix_corpus(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The columns of ``docs``, and size, source_size, target and taken as in ``mix_documents``; where ``docs`` has a column of such a name, an underscore is put before the new one."""
    names = ("size", "source_size", "target", "taken")
    out = _by_source(docs, seed, ["row"])
    return out.select("row.*", *[F.col(c).alias(name) for c, name in zip(names, private(docs, *names), strict=True)])
