"""Interleaving of sources by target shares with Pfair scheduling.

Everything here is built-in functions and SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
ROUND_SLOTS = 100
BUCKETS = 1024


def _div(number: Column, by: Column) -> Column:
    return F.floor((number - F.pmod(number, by)) / by).cast("bigint")


def shares_by_size(sizes: dict, power: float = 0.5, slots: int = ROUND_SLOTS) -> dict:
    """Whole shares of a round in proportion to a power of the sources' sizes."""
    weight = {s: n**power for s, n in sizes.items()}
    total = sum(weight.values())
    return {s: max(1, round(slots * w / total)) for s, w in weight.items()}


def _ranked(docs: DataFrame, source: Column, key: str, buckets: int) -> DataFrame:
    """Each row with its place in its source, in the order of a hash.

    A source is cut into buckets of the hash; the sizes of the buckets before are
    added to the place in the bucket. So a source with most of the rows is spread
    over as many tasks as it has buckets.
    """
    mixed = F.xxhash64(F.col(key), F.lit("mix"))
    # own columns in one, whatever their names are
    rows = docs.select(
        F.struct("*").alias("_row"), source.alias("_source"), F.col(key).alias("_key"), mixed.alias("_hash")
    )
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", "_key")
    return (
        rows.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(sizes, ["_source", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_inside"))
        .drop("_hash", "_bucket", "_before", "_inside")
    )


def schedule(spark, blocks: dict, shares: dict) -> DataFrame:
    """Slots of the blocks in every kind of round: stretch, source, turn, slot.

    In a round each source has as many blocks as its share, or what it has left. Block
    i of a source with share a is due in the fluid schedule between i / a and
    (i + 1) / a of the round; counted in slots that is
    T(v) = sum of min(left, share * v) over all sources, and the block is released at
    the floor of the first and due at the ceiling of the second. Slot by slot, the
    released block with the earliest deadline is taken (ties: source, then turn).
    Within a round there are `sum of shares` slots at most. Rounds differ only where a
    source ends, so there are at most 2 * sources + 1 stretches of like rounds,
    whatever the data's size; `first_round`, `first_slot` and `slots` tell of them.
    """
    order = sorted(blocks)
    a = [shares[s] for s in order]
    n = [blocks[s] for s in order]
    turns = sorted({0, *(x // y for x, y in zip(n, a)), *(x // y + 1 for x, y in zip(n, a))})
    left = [[max(0, min(y, x - y * m)) for x, y in zip(n, a)] for m in turns]
    start = [sum(min(x, y * m) for x, y in zip(n, a)) for m in turns]
    whole = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    stretches = spark.range(1).select(
        F.posexplode(F.arrays_zip(whole(turns).alias("first_round"), whole(start).alias("first_slot"), F.array(*[whole(x) for x in left]).alias("left"))).alias("stretch", "x")
    ).select("stretch", "x.*").withColumn("shares", whole(a))
    jobs = stretches.select(
        "*", F.posexplode("left").alias("place", "own")
    ).where("own > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own") - 1)).alias("turn"))
    share = F.get("shares", F.col("place"))

    def fluid(v: Column) -> Column:
        """T(v / share) * share, in whole numbers."""
        each = F.zip_with("left", "shares", lambda l, s: F.least(l * share, s * v))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda t, x: t + x)

    due = fluid(F.col("turn") + 1)
    jobs = jobs.select(
        "stretch", "first_round", "first_slot",
        F.struct(
            _div(due + share - 1, share).alias("deadline"),
            F.col("place"), F.col("turn"), _div(fluid(F.col("turn")), share).alias("release"),
        ).alias("job"),
    )
    gathered = jobs.groupBy("stretch", "first_round", "first_slot").agg(F.array_sort(F.collect_list("job")).alias("jobs"))
    none = F.filter("jobs", lambda j: F.lit(False))
    state = F.struct(F.col("jobs").alias("waiting"), none.alias("taken"))

    def step(s: Column, slot: Column) -> Column:
        best = F.get(F.filter(s["waiting"], lambda j: j["release"] <= slot), F.lit(0))
        return F.struct(
            F.filter(s["waiting"], lambda j: ~((j["place"] == best["place"]) & (j["turn"] == best["turn"]))).alias("waiting"),
            F.concat(s["taken"], F.array(best)).alias("taken"),
        )

    taken = F.aggregate(F.sequence(F.lit(0), F.size("jobs") - 1), state, step, lambda s: s["taken"])
    return (
        gathered.select("stretch", "first_round", "first_slot", F.size("jobs").cast("bigint").alias("slots"), F.posexplode(taken).alias("slot", "job"))
        .select("stretch", "first_round", "first_slot", "slots", F.col("slot").cast("bigint").alias("slot"), "job.place", "job.turn", "job.release", "job.deadline")
    )


def mix(
    docs: DataFrame,
    shares: dict | None = None,
    id_column: str = "doc_id",
    source_column: str = "source",
    block_rows: int = BLOCK_ROWS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Each row with its place in the mixture: block, block_slot, mix_position.

    A source's rows, in the order of a hash of the key, form blocks of `block_rows`;
    the last may be shorter. Blocks are put in slots so that after every slot each
    source has got its share of them, give or take less than one block. Where a source
    ends, the shares of the others go on. Every row has one place, and
    mix_position = block_slot * block_rows + place in the block orders them.

    `shares` are whole numbers per source, in proportion to the target weights;
    sources without one have 1, and without any shares they follow the square root of
    the sizes. A missing source is a source of its own, named "". Rows with the same
    key follow one another in some order. The number of sources must be small enough
    for the driver: it gets a row for each. Other columns are kept; columns named
    block, block_slot or mix_position are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "block_slot", "mix_position")
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    sizes = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return docs.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("block", "block_slot", "mix_position")])
    shares = shares_by_size(sizes) if shares is None else {s: shares.get(s, 1) for s in sizes}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    order = sorted(sizes)
    table = schedule(spark, blocks, shares)
    place = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    share = F.create_map(*[F.lit(x) for s in order for x in (s, shares[s])])
    turns = sorted({0, *(blocks[s] // shares[s] for s in order), *(blocks[s] // shares[s] + 1 for s in order)})
    begins = F.array(*[F.lit(t) for t in turns]).cast("array<bigint>")
    rows = (
        _ranked(docs, source, id_column, buckets)
        .withColumn("block", F.expr(f"_rank div {block_rows}"))
        .withColumn("place", place[F.col("_source")])
        .withColumn("_share", share[F.col("_source")].cast("bigint"))
        .withColumn("_round", F.expr("block div _share"))
        .withColumn("turn", F.expr("block % _share"))
        .withColumn("stretch", F.size(F.filter(begins, lambda b: b <= F.col("_round"))) - 1)
    )
    # a row for each slot of each kind of round: bounded by sources and shares
    joined = rows.join(F.broadcast(table), ["stretch", "place", "turn"])
    slot = F.col("first_slot") + (F.col("_round") - F.col("first_round")) * F.col("slots") + F.col("slot")
    return joined.withColumn("block_slot", slot).select(
        "_row.*",
        "block",
        "block_slot",
        (F.col("block_slot") * block_rows + F.col("_rank") % block_rows).alias("mix_position"),
    )
