"""Sampling, splits, clusters, deduplication and synthetic negatives. Chance comes from hashes, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions import tables

from . import similarity


def uniform(seed: object, *keys: Column) -> Column:
    """A number from 0 to 1 by the md5 of seed and keys."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: object = 0) -> DataFrame:
    """``n`` draws with replacement, (draw, key), in proportion to weight: each draw's point falls in one row's stretch of the cumulative weights.

    Weights are summed over ranges of the key's hash first, so no task gets all rows; a range is drawn
    and then a row of it.
    """
    rows = df.filter(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("w"), F.pmod(F.xxhash64(key), F.lit(1024)).alias("part"))
    parts = rows.groupBy("part").agg(F.sum("w").alias("own"))
    ends = Window.orderBy("part")
    parts = parts.select("part", "own", F.sum("own").over(ends).alias("end"), F.sum("own").over(Window.partitionBy()).alias("all"))  # 1,024 rows at most
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("u", uniform(seed, F.col("draw")))
    cut = draws.join(F.broadcast(parts), (F.col("u") * F.col("all") >= F.col("end") - F.col("own")) & (F.col("u") * F.col("all") < F.col("end"))).select("draw", "part", (F.col("u") * F.col("all") - F.col("end") + F.col("own")).alias("x"))
    inside = Window.partitionBy("part").orderBy(key)
    rows = rows.withColumn("end", F.sum("w").over(inside)).withColumn("begin", F.col("end") - F.col("w"))
    found = cut.join(rows, "part").filter((F.col("x") >= F.col("begin")) & (F.col("x") < F.col("end")))
    return found.select("draw", key)


def holdout(clusters: DataFrame, share: float = 0.2, seed: object = 0) -> DataFrame:
    """(cluster, held): the nearest whole number of ``share`` of all clusters, whole ones, by hash."""
    own = clusters.select("cluster").distinct()
    rank = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("cluster").cast("string"))), "cluster"))
    return own.withColumn("held", rank <= F.bround(F.lit(share) * F.count("*").over(Window.partitionBy())))


def permuted(df: DataFrame, key: str, label: str, seed: object = 0) -> DataFrame:
    """``df`` with its labels dealt out anew: the row at each place by key gets the label at that place by hash."""
    places = df.withColumn("at", F.row_number().over(Window.orderBy(key)))
    labels = df.select(F.col(label).alias("dealt"), F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)).alias("at"))
    return places.join(labels, "at").drop("at", label).withColumnRenamed("dealt", label)


def with_clusters(rows: DataFrame, clusters: DataFrame, most_alone: float = 0.05) -> DataFrame:
    """``rows`` with the cluster of their sequence (member, representative), themselves if they have none; ValueError if too many have none."""
    out = rows.join(clusters.select(F.col("member").alias("sequence"), F.col("representative").alias("cluster")).dropDuplicates(["sequence"]), "sequence", "left")
    alone = out.agg(F.avg(F.col("cluster").isNull().cast("double")).alias("x")).first()["x"] or 0.0
    if alone > most_alone:
        raise ValueError(f"{alone:.1%} of the rows are in no cluster")
    return out.withColumn("cluster", F.coalesce("cluster", "sequence"))


def with_folds(rows: DataFrame, splits: DataFrame, held: int = 0, seed: object = 42) -> DataFrame:
    """``rows`` with validation: whether their fold (sequence, fold) is the held one; without any fold a tenth by hash."""
    own = splits.groupBy("sequence").agg(F.min("fold").alias("fold"))
    out = rows.join(own, "sequence", "left").withColumn("some", F.max(F.col("fold").isNotNull()).over(Window.partitionBy()))
    chance = uniform(seed, F.col("sequence")) >= 0.9
    return out.withColumn("validation", F.when(F.col("some"), F.coalesce(F.col("fold") == held, F.lit(False))).otherwise(chance)).drop("some", "fold")


def all_found(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to a table that must have every key: ValueError names how many it lacks."""
    lost = rows.join(table, key, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no match by {key}")
    return rows.join(table, key)


def deduplicated(library: DataFrame, ceiling: float = 0.80, top: int = 200) -> DataFrame:
    """(pos, sequence) of a library in order, without those as alike as ``ceiling`` to one kept before, of those that share a 3-mer with it.

    Links come from the shortlist join. A sequence without a link to an earlier one stays, and one
    whose earlier links are all gone stays; so rounds settle sequences whose earlier ones are settled.
    """
    rows = library.groupBy("sequence").agg(F.min("pos").alias("pos")).persist()
    own = rows.select("sequence")
    pairs = similarity.shortlist(own, own.withColumnRenamed("sequence", "x").select(F.col("x").alias("sequence")), top=top + 1).filter("sequence <> ref")
    order = rows.withColumnRenamed("sequence", "ref").withColumnRenamed("pos", "ref_pos")
    earlier = pairs.join(rows, "sequence").join(order, "ref").filter("ref_pos < pos").withColumn("identity", similarity.pair_identity()("sequence", "ref")).filter(F.col("identity") >= ceiling).select("sequence", "ref").persist()
    state = rows.join(earlier.select("sequence").distinct(), "sequence", "left_semi").select("sequence", F.lit(None).cast("boolean").alias("kept"))
    state = rows.join(state.select("sequence"), "sequence", "left_anti").select("sequence", F.lit(True).alias("kept")).union(state).persist()
    while not state.filter("kept is null").isEmpty():
        known = earlier.join(state.select(F.col("sequence").alias("ref"), F.col("kept").alias("ref_kept")), "ref")
        told = known.groupBy("sequence").agg(F.max(F.coalesce("ref_kept", F.lit(False))).alias("hit"), F.count_if(F.col("ref_kept").isNull()).alias("open"))
        verdict = F.when(F.col("hit"), False).when(F.col("open") == 0, True)
        state = state.join(told, "sequence", "left").select("sequence", F.coalesce("kept", verdict).alias("kept")).persist()
    return rows.join(state.filter("kept"), "sequence").select("pos", "sequence").orderBy("pos")


def clustered(df: DataFrame, identity: float = 0.40, coverage: float = 0.80, top: int = 400) -> DataFrame:
    """(representative, member): sequences dealt to the longest one, then first by name, among those alike enough that lead a cluster.

    Candidates share a 3-mer; a pair is alike if its identity and the shorter one's share of the longer
    reach the bounds. A sequence that leads none of its links is a member of its best leader: one greedy
    round by length, as set cover. The definition is the engine's own.
    """
    own = df.select("sequence").distinct()
    pairs = similarity.shortlist(own, own, top=top).filter("sequence <> ref")
    n, m = F.length("sequence"), F.length("ref")
    alike = pairs.filter(F.least(n, m) / F.greatest(n, m) >= coverage).withColumn("identity", similarity.pair_identity()("sequence", "ref")).filter(F.col("identity") >= identity)
    before = alike.filter((m > n) | ((m == n) & (F.col("ref") < F.col("sequence"))))
    leaders = own.join(before.select("sequence"), "sequence", "left_anti")
    best = before.join(leaders.select(F.col("sequence").alias("ref")), "ref", "left_semi").groupBy("sequence").agg(F.max_by("ref", F.struct(F.length("ref"), "identity", "ref")).alias("representative"))
    return own.join(best, "sequence", "left").select(F.coalesce("representative", "sequence").alias("representative"), F.col("sequence").alias("member"))


def uniform_lengths(spark, total: int, low: int, high: int) -> DataFrame:
    """(length, count): ``total`` dealt evenly over lengths, the rest to the shortest."""
    n = high - low + 1
    return spark.range(n).select((F.col("id") + low).cast("int").alias("length"), (F.lit(total // n) + (F.col("id") < total % n).cast("int")).cast("long").alias("count"))


def empirical_lengths(lengths: DataFrame, total: int, low: int = tables.MIN_LENGTH, high: int = tables.MAX_LENGTH) -> DataFrame:
    """(length, count): ``total`` in proportion to observed lengths in range, by largest remainder, the shorter first on ties; ValueError without any."""
    seen = lengths.filter(F.col("length").between(low, high)).groupBy("length").agg(F.count("*").alias("n"))
    if seen.isEmpty():
        raise ValueError("no length in range")
    exact = F.lit(total) * F.col("n") / F.sum("n").over(Window.partitionBy())
    out = seen.withColumn("exact", exact).withColumn("low", F.floor("exact"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("low"), 12)), "length"))
    rest = F.lit(total) - F.sum("low").over(Window.partitionBy())
    return out.withColumn("count", (F.col("low") + (rank <= rest).cast("int")).cast("long")).filter("count > 0").select("length", "count")


def capped_reference(df: DataFrame, longest: int) -> DataFrame:
    """Reference lengths up to a cap; ValueError if the cap is below the shortest peptide or leaves none."""
    out = df.filter(F.col("length") <= longest)
    if longest < tables.MIN_LENGTH or out.isEmpty():
        raise ValueError(f"no reference length up to {longest}")
    return out


def gathered(make, wanted: int, rounds: int = 12, oversample: float = 1.6) -> list[str]:
    """Distinct sequences of ``make(round, asked)`` frames until ``wanted`` are there, sorted; ValueError if the rounds don't suffice. They are a library, which the driver holds."""
    kept: dict[str, None] = {}
    for k in range(rounds):
        asked = int(oversample * (wanted - len(kept))) + 1
        kept |= dict.fromkeys(r["sequence"] for r in make(k, asked).select("sequence").toLocalIterator())
        if len(kept) >= wanted:
            return sorted(list(kept)[:wanted])
    raise ValueError(f"{len(kept)} of {wanted} after {rounds} rounds")


def indels(sequence: Column, seed: object = 0, k: int = 5) -> Column:
    """A sequence after ``k`` insertions or deletions by hash, within the bounds of lengths: for evaluation alone."""
    letters = F.lit(tables.AMINO_ACIDS)

    def step(state: Column, i: Column) -> Column:
        n, u = F.length(state), lambda what: uniform(f"{seed}{what}", sequence, i)
        at = F.floor(u("at") * n).cast("int")
        short = F.concat(F.substring(state, F.lit(1), at), F.substring(state, at + 2, n))
        to = F.floor(u("to") * (n + 1)).cast("int")
        long = F.concat(F.substring(state, F.lit(1), to), F.substring(letters, F.floor(u("letter") * 20).cast("int") + 1, F.lit(1)), F.substring(state, to + 1, n))
        return F.when((u("kind") < 0.5) & (n > tables.MIN_LENGTH), short).when(n < tables.MAX_LENGTH, long).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), sequence, step)


def masks_at(seed: object, key: Column, share: Column) -> tuple[Column, Column]:
    """A row's kind of mask (iid, span, face at 0.5, 0.25, 0.25) and its iid mask, by hash."""
    u = uniform(f"{seed}kind", key)
    kind = F.when(u < 0.5, "iid").when(u < 0.75, "span").otherwise("face")
    return kind, F.transform(F.sequence(F.lit(0), F.lit(tables.MAX_LENGTH - 1)), lambda i: uniform(f"{seed}place", key, i) < share)


def prefix_of(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of one ranking (rank, sequence)."""
    return ranked.filter(F.col("rank") <= k)
