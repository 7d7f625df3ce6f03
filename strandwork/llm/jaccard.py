"""N-gram Jaccard join: a grouped prefix join over word shingles, with links contracted as they are found.

A document's shingles are put in a global order, rare ones first, and two sets alike enough must share
one of the first few: their prefixes. Any order is right; this one comes from a table of counts over
all documents, of fixed size. Documents of identical prefix and set size are one group, and only groups
spread their prefix shingles. Two groups that share one are a pair, if sizes and places of the shared
shingle allow the overlap that is needed. Pairs of groups are then expanded to their members' distinct
sets; parity bitmaps, as long as the sets are large, drop pairs that differ too much (differing bits
never outnumber differing shingles, so none is lost), and the whole texts of the rest are compared.

A large collection of near copies would give pairs by the square of its size. So every group is first
compared with one leader alone, of those that its prefix shingles name the one that shares most of
them; a shingle names the group whose prefix is most shared, the least edited copy of a collection.
Members of a group are compared with the group's first. That joins most of such a collection; then all
pairs of sets not yet joined are tested, their parities before they are made a row. No link between
components is lost; links within one are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph, shingles

#: Words of a shingle; least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Counters of the order, bits of the filters of shared shingles and of documents to compare. None grows with the data, and none decides a result.
SKETCH_BITS, SHARED_BITS, FILTER_BITS = 16, 24, 23
#: Longs of the small parity bitmap that goes with shingles.
SMALL = 8
#: Documents compared with one leader in a task; a set that has this share of all documents, or more, is handed to every task.
CHUNK, HOT = 64, 1000


def needed(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of sets of sizes a and b that are similar enough."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def sketch(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all documents, by the top bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text"):
                found, _ = shingles.hashes(part.column("text").to_pylist(), words)
                total += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(full, pa.int64()), "n": pa.array(total[full])})

    counts = texts.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[counts["place"].to_numpy()] = counts["n"].to_numpy()
    return out


def parity(own: np.ndarray) -> tuple[list[int], bytes | None]:
    """Whether an odd number of a set's hashes falls on each bit: in SMALL longs, and for larger sets in the power of two of bits that their size asks for."""

    def bits(size: int) -> np.ndarray:
        odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little")

    large = bits(1 << (len(own) - 1).bit_length()).tobytes() if len(own) > 64 * SMALL else None
    return bits(64 * SMALL).view(np.int64).tolist(), large


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two sets' parities differ, the longer one folded to the other's length: no more than the shingles in which the sets differ."""
    a, b = (int.from_bytes(v, "little") for v in (x, y))
    n, m = 8 * len(x), 8 * len(y)
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & (1 << n) - 1)
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & (1 << m) - 1)
    return (a ^ b).bit_count()


SHAPE = "doc_id long, n long, a long, b long, grp long, prefix array<long>, small array<long>, bits binary"


def prefixes(docs: DataFrame, order: np.ndarray, words: int, percent: int) -> DataFrame:
    """For each document: doc_id, n (its set's size), a and b (128 bits of the set), grp (64 bits of its prefix and size), prefix (shingles, in order), small and bits (``parity``)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = shingles.hashes(batch.column("text").to_pylist(), words)
        n, a, b, groups, heads, maps = [], [], [], [], [], []  # maps: small and bits
        signed = lambda x: int(x.view(np.int64))
        for own in np.split(found, np.cumsum(counts)[:-1]):
            own = np.unique(own)
            n.append(len(own))
            a.append(signed(own.sum(dtype=np.uint64)))
            b.append(signed(shingles.mixed(own).sum(dtype=np.uint64)))
            rank = np.lexsort((own, order[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
            head = own[rank[: len(own) - -(-percent * len(own) // 100) + 1]] if len(own) else own
            heads.append(head.view(np.int64))
            groups.append(signed(shingles.mixed(shingles.mixed(head ^ np.uint64(len(own))).sum(dtype=np.uint64, keepdims=True))[0]))
            maps.append(parity(own))
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, a, b, groups)), pa.array(heads, pa.list_(pa.int64())), pa.array([m[0] for m in maps], pa.list_(pa.int64())), pa.array([m[1] for m in maps], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SHAPE.split(", ")])

    return common.map_texts(docs, ["doc_id", "text"], "text", run, SHAPE)


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits, set at each value of the one column of ``values``, made in the executors; the driver holds the map alone."""
    per_row = 8 * 4096
    (name,) = values.columns
    rows = values.groupBy(F.expr(f"{name} div {per_row}").alias("row")).agg(F.expr(f"bitmap_construct_agg({name} % {per_row})").alias("bits")).collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in rows:
        own = np.frombuffer(row["bits"], np.uint8)[: len(out)]
        out[row["row"] * 4096 : row["row"] * 4096 + len(own)] = own
    return out


def inside(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def spread(rows: DataFrame, held: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(token, grp, n, place, hot) of the prefix shingles whose lowest bits are in the bitmap ``held``; ``hot`` if they are among those."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("prefix")
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        token = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(inside(held, token & ((1 << SHARED_BITS) - 1)))
        own = pa.array(row[hit])
        columns = [pa.array(token[hit]), batch.column("grp").take(own), batch.column("n").take(own), pa.array(place[hit]), pa.array(np.isin(token[hit], hot))]
        return pa.RecordBatch.from_arrays(columns, names=["token", "grp", "n", "place", "hot"])

    return rows.select("prefix", "grp", "n").mapInArrow(lambda batches: map(run, batches), "token long, grp long, n long, place long, hot boolean")


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) of sets that their sizes and parities (``sets``: id, n, small, bits) don't rule out."""
    own = ("n", "small", "bits")
    side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in own])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        parity_of = lambda small, bits: bits if bits is not None else np.array(small, "<i8").tobytes()
        columns = (batch.column(f"{c}_{x}").to_pylist() for x in "ab" for c in own)
        for i, (n, small_a, bits_a, m, small_b, bits_b) in enumerate(zip(*columns, strict=True)):
            least = -(-percent * (n + m) // (100 + percent))
            if 100 * min(n, m) >= percent * max(n, m) and differing(parity_of(small_a, bits_a), parity_of(small_b, bits_b)) <= n + m - 2 * least:
                ok.append(i)
        return batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}_{x}" for x in "ab" for c in own])
    return both.mapInArrow(lambda batches: map(run, batches), "a long, b long").distinct()


def similar(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of doc_ids whose whole texts' shingle sets are similar enough.

    The documents in pairs are picked by a bitmap of fixed size, and exactly by the join that follows.
    Pairs of one ``a`` are compared CHUNK at a time: the text of ``a`` moves once for each chunk, and
    that of ``b`` once for each pair. A task holds the sets of one ``a`` and one ``b`` at a time.
    """
    spot = lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - FILTER_BITS)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    cut = pairs.join(parts, "a").withColumn("chunk", F.expr("pmod(xxhash64(b), parts)").cast("int"))
    leaders = parts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"))
    sides = common.checkpointed(leaders.union(cut.select(F.col("b").alias("doc_id"), "a", "chunk", "b")))
    held = bitmap(sides.select(spot("doc_id").alias("k")), FILTER_BITS)

    @F.pandas_udf("boolean")
    def asked(k: pd.Series) -> pd.Series:
        return pd.Series(inside(held, k.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []  # the chunk's leader and its sets: one for each text of its id
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = list(zip(*(part.column(c).to_pylist() for c in ("a", "chunk", "b", "text")), strict=True))
                if not rows:
                    continue
                found, counts = shingles.hashes([r[3] for r in rows], words)
                ok = []
                for (a, chunk, b, _), s in zip(rows, map(np.unique, np.split(found, np.cumsum(counts)[:-1])), strict=True):
                    if (a, chunk) != key:
                        key, own = (a, chunk), []
                    if b is None:
                        own.append(s)
                        continue
                    for x in own:
                        shared = len(np.intersect1d(x, s, assume_unique=True))
                        if shared and 100 * shared >= percent * (len(x) + len(s) - shared):
                            ok.append((a, b))
                            break
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in ok], pa.int64()), "b": pa.array([p[1] for p in ok], pa.int64())})

    texts = docs.filter(F.col("doc_id").isNotNull()).filter(asked(spot("doc_id"))).join(sides, "doc_id").select("a", "chunk", "b", "text")
    return texts.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long").distinct()


def room(x: str, y: str) -> Column:
    """Most shingles that two sets can share if one at these places is the first that they do."""
    return F.least(F.col(f"{x}n") - F.col(f"{x}place"), F.col(f"{y}n") - F.col(f"{y}place"))


def fits(x: str, y: str, percent: int) -> Column:
    """Whether sets x and y, by their sizes and the places of a shingle that they share, may overlap enough."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (room(x, y) >= needed(n, m, percent))


def shared_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """(token, grp, n, place, c, other) of prefix shingles that several groups share: ``c`` of them.

    A shingle of two groups gives one row, with the ``other`` group, if sizes and places don't rule the
    pair out. A shingle with more than one in HOT of all documents is ranked by sums that are made
    before rows move and then go to every task, as there are at most HOT times as many of these as a
    prefix is long; other shingles' rows move once and meet in a task.
    """
    counts = common.checkpointed(rows.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"))
    held = bitmap(counts.select(F.col("token").bitwiseAND(F.lit((1 << SHARED_BITS) - 1)).alias("k")), SHARED_BITS)
    often = F.broadcast(counts.filter((F.col("c") * HOT >= rows.count()) & (F.col("c") > CHUNK)).select("token"))
    hot = np.array([r["token"] for r in often.collect()], np.int64)
    own = spread(rows, held, hot)
    pair = F.struct("n", "place", "grp")
    stats = {"c": F.count("*"), "x": F.min(pair), "y": F.max(pair)}
    alone = Window.partitionBy("token")
    cold = own.filter("not hot").repartition(F.col("token")).dropDuplicates(["token", "grp"]).withColumns({k: v.over(alone) for k, v in stats.items()})
    # members of a group have equal prefixes, so any one's row is the group's
    grouped = own.filter("hot").groupBy("token", "grp").agg(F.first("n").alias("n"), F.first("place").alias("place"))
    ends = F.broadcast(grouped.groupBy("token").agg(*[v.alias(k) for k, v in stats.items()]))
    columns = ["token", "grp", "n", "place", "c", "x", "y"]
    both = cold.select(*columns).union(grouped.join(ends, "token").select(*columns))
    two = (F.col("c") == 2) & (F.col("grp") == F.col("x.grp")) & fits("x.", "y.", percent)
    return common.checkpointed(both.filter((F.col("c") > 2) | two).select(*columns[:5], F.when(F.col("c") == 2, F.col("y.grp")).alias("other")))


def linked(docs: DataFrame, rows: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect all similar sets, by their set_ids."""
    found = shared_shingles(rows, percent)
    twos = common.checkpointed(found.filter("other is not null").select("grp", "other").distinct())
    shared = found.filter("other is null").drop("other")
    bits = rows.join(sets.select("n", "a", "b", F.col("set_id").alias("doc_id")), ["doc_id", "n", "a", "b"], "left_semi").select(F.col("doc_id").alias("id"), "n", "small", "bits").distinct()
    heads = common.checkpointed(sets.groupBy("grp").agg(F.min("set_id").alias("head")))
    headed = lambda df, x, y: df.join(heads.select(F.col("grp").alias(x), F.col("head").alias("a")), x).join(heads.select(F.col("grp").alias(y), F.col("head").alias("b")), y).select("a", "b").filter("a <> b")
    open_ = common.checkpointed(shared.join(shared.groupBy("grp").agg(F.sum("c").alias("score")), "grp"))
    named = open_.join(open_.groupBy("token").agg(F.max_by("grp", F.struct("score", "grp")).alias("leader")), "token").filter("grp <> leader").groupBy("grp", "leader").agg(F.count("*").alias("c"))
    ahead = headed(named.groupBy("grp").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader")), "leader", "grp")
    within = sets.join(heads, "grp").filter("set_id <> head").select(F.col("head").alias("a"), F.col("set_id").alias("b"))
    tested = common.checkpointed(ahead.union(within).union(headed(twos, "grp", "other")).distinct())
    links = common.checkpointed(similar(docs, common.checkpointed(near(tested, bits, percent)), words, percent))
    label = graph.components(links)
    members = common.checkpointed(sets.join(label.withColumnRenamed("id", "set_id"), "set_id", "left").select("grp", "set_id", "n", F.coalesce("label", "set_id").alias("label")))
    spans = common.checkpointed(members.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("sets")))
    split = open_.join(spans, "grp").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("token")
    open_ = open_.join(split, "token", "left_semi")

    # a group whose members are not all joined is a shingle of its own that they share in the first place
    start = F.lit(0).cast("long").alias("place")
    rest = open_.select("token", "grp", "place").union(spans.filter("lo < hi").select("grp", "grp", start))
    # so is a pair of groups, if one of them has several sets: only the first of each have been compared
    several = spans.filter("sets > 1").select("grp")
    wide = twos.join(several, "grp", "left_semi").union(twos.join(several.withColumnRenamed("grp", "other"), "other", "left_semi").select("grp", "other")).distinct()
    rest = rest.union(wide.select(F.xxhash64("grp", "other").alias("token"), F.explode(F.array("grp", "other")).alias("grp"), start))
    rest = rest.join(members, "grp").select("token", "place", "set_id", "n", "label")
    rest = common.checkpointed(rest.join(bits.select(F.col("id").alias("set_id"), "n", "small"), ["set_id", "n"]))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    differ = sum((F.bit_count(x("small")[i].bitwiseXOR(y("small")[i])) for i in range(SMALL)), F.lit(0))
    across = (x("token") == y("token")) & (x("set_id") < y("set_id")) & (x("label") != y("label")) & fits("x.", "y.", percent)
    across = across & (differ <= x("n") + y("n") - 2 * needed(x("n"), y("n"), percent))
    left = rest.alias("x").join(rest.alias("y"), across).select(x("set_id").alias("a"), y("set_id").alias("b")).distinct()
    left = left.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = similar(docs, common.checkpointed(near(left, bits, percent)), words, percent)
    return links.union(more)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, set_id and component_id.

    A document's set holds its distinct shingles of ``words`` words, A-Z in lower case; a text of fewer
    words is one shingle; without words (or null) the set is empty and linked with nothing. Documents
    link when their sets' Jaccard similarity is at least ``percent`` hundredths. ``set_id`` is the
    smallest doc_id with the same set, ``component_id`` the smallest reachable by links. Rows that share
    a doc_id are one document, linked if any of its texts is. A row without doc_id has null ids and
    links nothing. A text of any length is one row in a task, its hashes 8 bytes for each word; other
    columns are ignored, an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = common.checkpointed(prefixes(docs, sketch(docs, words), words, percent))
    known = rows.filter("n > 0 and doc_id is not null")
    sets = common.checkpointed(known.groupBy("n", "a", "b").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("c"), F.first("grp").alias("grp")))
    links = common.settled(lambda: linked(docs, known, sets, words, percent))
    # rows that share a doc_id join their sets
    several = known.groupBy("doc_id").agg((F.min("a") != F.max("a")).alias("x"), (F.min("b") != F.max("b")).alias("y"), (F.min("n") != F.max("n")).alias("z")).filter("x or y or z").select("doc_id")
    own = known.select("doc_id", "n", "a", "b").join(several, "doc_id").join(sets.select("n", "a", "b", "set_id"), ["n", "a", "b"])
    own = own.join(own.groupBy("doc_id").agg(F.min("set_id").alias("first")), "doc_id").filter("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    label = graph.components(links.union(own))

    labelled = sets.join(label.withColumnRenamed("id", "set_id"), "set_id", "left").select("n", "a", "b", "c", "set_id", F.coalesce("label", "set_id").alias("component_id"))
    labelled = common.checkpointed(labelled)
    total = rows.count()
    # at most HOT sets have so many rows each, so they go to every task and no key of the other join has more
    hot = F.broadcast(labelled.filter(F.col("c") * HOT >= total).drop("c"))
    keys, out = ["n", "a", "b"], ["doc_id", F.col("n").alias("n_shingles"), "set_id", "component_id"]
    ids = known.select("doc_id", "n", "a", "b")
    often = ids.join(hot, keys).select(*out)
    rarely = ids.join(hot, keys, "left_anti").join(labelled.filter(F.col("c") * HOT < total).drop("c"), keys).select(*out)
    alone = rows.filter("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("set_id"), F.col("doc_id").alias("component_id"))
    return often.union(rarely).union(alone)


def distinct_docs(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` without those that have a smaller doc_id in their component; rows without doc_id stay."""
    gone = components(docs, **options).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
