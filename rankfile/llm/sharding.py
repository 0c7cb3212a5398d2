"""K-d tree sharding: distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ranked, store

#: Levels into which a dimension is quantised, and bits of the tie-breaking hash: together a non-negative long.
DIM_BITS, TIE_BITS, ROUND_BITS = 22, 40, 16
LEVELS = 1 << DIM_BITS
DIMS = ["d_size", "d_source", "d_lang"]
#: A group of equal texts over this share of a leaf's bytes is split; smaller ones stay whole.
HOT_SHARE = 1 / 8


def size_of(text: Column) -> Column:
    """UTF-8 bytes and 1 for the separator; null: 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _medians(items: DataFrame, dims: list[str]) -> dict[int, tuple[str, int]]:
    """For each node its widest dimension and the key at which its weight halves.

    Extents are one grouped aggregate. The weighted median is exact to the last key: each round sums weights over the
    next ROUND_BITS of the key, finds the bin that holds the half (a window over at most 2 ** ROUND_BITS bins of a
    node) and goes on in it, until the bin's own weight no longer matters or the bits end.
    """
    stats = items.groupBy("_node").agg(F.sum("w").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).collect()
    chosen = {r["_node"]: max(dims, key=lambda d: (r[d], -dims.index(d))) for r in stats}
    state = {r["_node"]: {"half": r["w"] / 2, "base": 0.0, "prefix": 0, "total": r["w"]} for r in stats}
    bits = DIM_BITS + TIE_BITS
    dim_key = F.coalesce(*[F.when(F.col("_node") == n, F.col(d)) for n, d in chosen.items()])
    keyed = items.select("_node", "w", F.shiftleft(dim_key, TIE_BITS).bitwiseOR(F.col("tie")).alias("k"))
    done: dict[int, int] = {}
    used = 0
    while len(done) < len(state):
        step = min(ROUND_BITS, bits - used)
        open_nodes = [n for n in state if n not in done]
        within = reduce(lambda a, b: a | b, [(F.col("_node") == n) & (F.shiftright("k", bits - used) == state[n]["prefix"]) for n in open_nodes])
        bins = keyed.where(within).groupBy("_node", F.shiftright("k", bits - used - step).alias("bin")).agg(F.sum("w").alias("w"))
        upto = Window.partitionBy("_node").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("w").over(upto))
        half = F.coalesce(*[F.when(F.col("_node") == n, F.lit(state[n]["half"] - state[n]["base"])) for n in open_nodes])
        found = bins.where((F.col("upto") >= half) & (F.col("upto") - F.col("w") < half)).collect()
        used += step
        for r in found:
            s = state[r["_node"]]
            before, after = s["base"] + r["upto"] - r["w"], s["base"] + r["upto"]
            s["base"], s["prefix"] = before, r["bin"]
            if r["w"] <= 1e-4 * s["total"] or used >= bits:
                low = abs(before - s["half"]) < abs(after - s["half"])
                done[r["_node"]] = (r["bin"] if low else r["bin"] + 1) << (bits - used)
        for n in open_nodes:  # a node without rows in reach of the half (all weight zero) splits at the start
            if n not in {r["_node"] for r in found} and n not in done:
                done[n] = 0
    return {n: (chosen[n], done[n]) for n in state}


def kd_leaves(items: DataFrame, dims: list[str], shards: int, rows: int) -> DataFrame:
    """`items` with _node, from `shards` to 2 * shards - 1: the leaf that the splits lead to.

    items: `dims` (levels below 2 ** DIM_BITS), tie (below 2 ** TIE_BITS, distinct) and w. An item goes right if its key,
    the level and then the tie, is at least the node's median key. rows: about how many items there are.
    """
    items = items.withColumn("_node", F.lit(1))
    for _ in range(shards.bit_length() - 1):
        cuts = _medians(items, dims)
        goes_right = F.coalesce(*[F.when(F.col("_node") == n, F.shiftleft(F.col(d), TIE_BITS).bitwiseOR(F.col("tie")) >= F.lit(cut)) for n, (d, cut) in cuts.items()], F.lit(False))
        # narrow rows; written so that neither plan nor expressions grow from level to level
        items = store(items.withColumn("_node", F.col("_node") * 2 + goes_right.cast("int")), "shard-items", rows)
    return items


def kd_items(docs: DataFrame, shards: int, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int]:
    """The rows of `docs` as (doc_id, keep, size, text_crc32, _t, _part, _rid), the items that are to be placed, their
    number at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = store(
        docs.select("doc_id", *keep, size_of(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_t"), F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.monotonically_increasing_id().alias("_rid")),
        "shard-rows",
    )
    # null is lowest: the least of a group's values is null if any is
    least = lambda c: F.min(F.struct(F.col(c).isNotNull().alias("k"), F.col(c).alias("v")))["v"].alias(c)
    groups = store(rows.groupBy("_t", "size").agg(F.count("*").alias("n"), least("_source"), least("_lang")), "shard-groups", rows.count())
    total = groups.agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.sum("n").alias("n"), F.max("size").alias("z")).first()
    n, w = total["n"] or 0, total["w"] or 0
    limit = w / shards * HOT_SHARE
    hot = groups.where((F.col("size") * F.col("n") > limit) & (F.col("n") > 1)).select(F.col("_t").alias("_ht"), F.col("size").alias("_hs"), F.least(F.col("n"), F.ceil(F.col("size") * F.col("n") / F.lit(max(limit, 1.0) / 4))).alias("_m"))
    # by its definition fewer than shards / HOT_SHARE groups are hot
    rows = rows.join(F.broadcast(hot), (F.col("_t") == F.col("_ht")) & (F.col("size") == F.col("_hs")), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_rid"), F.col("_m")), F.lit(0))).drop("_ht", "_hs", "_m")

    def levels(column: str) -> DataFrame:
        """Each distinct value's place among all, by bytes (null: 0, as no value comes before it), scaled to the levels."""
        places = store(ranked(groups.where(F.col(column).isNotNull()).select(column).distinct(), column, "_place"), "shard-places")
        top = places.count()
        level = F.floor((F.col("_place") + 1) * F.lit(float(LEVELS - 1)) / F.lit(float(max(1, top))))
        return places.select(F.col(column).alias(f"_v{column}"), level.cast("long").alias(f"d{column}"))

    placed = groups
    for column in ("_source", "_lang"):
        placed = placed.join(levels(column), F.col(column) == F.col(f"_v{column}"), "left").withColumn(f"d{column}", F.coalesce(f"d{column}", F.lit(0).cast("long")))
    d_size = F.floor(F.log("size") / F.lit(max(math.log(total["z"] or 1), 1e-9)) * F.lit(float(LEVELS - 1))).cast("long")
    parts = rows.groupBy("_t", "size", "_part").agg(F.sum("size").alias("w"))
    items = parts.join(placed.select(F.col("_t").alias("_gt"), F.col("size").alias("_gs"), "d_source", "d_lang"), (F.col("_t") == F.col("_gt")) & (F.col("size") == F.col("_gs")))
    tie = F.shiftrightunsigned(F.xxhash64("_t", "_part"), 64 - TIE_BITS)
    return rows, store(items.select("_t", "size", "_part", "w", d_size.alias("d_size"), "d_source", "d_lang", tie.alias("tie")), "shard-items", n), n


def kd_shards(docs: DataFrame, shards: int = 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (and `keep` columns).

    shards must be a power of two. Law `bytes`: shard sizes are as near equal as the medians allow. Dimensions are
    log size, and the places of source and lang among their distinct values by bytes (null lowest), each scaled to 2 **
    DIM_BITS levels. Equal texts form one item, put by their smallest source and lang, and stay in one shard, unless a
    group weighs over HOT_SHARE of a shard: that one is split by row into parts. Null text counts as empty (size 1, crc
    0); a text of any length is one item. Repeated rows are rows of their own, copies of one text. An empty table gives
    no rows; other columns are left out. Only the medians (one row a node) reach the driver. Slots are numbered by
    salted buckets, gapless from 0 in each shard.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    rows, items, n = kd_items(docs, shards, keep)
    if not n:
        return rows.select("doc_id", *keep, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    items = kd_leaves(items, DIMS, shards, n)
    items = items.select(F.col("_t").alias("_it"), F.col("size").alias("_is"), F.col("_part").alias("_ip"), (F.col("_node") - shards).cast("int").alias("shard"))
    placed = rows.join(items, (F.col("_t") == F.col("_it")) & (F.col("size") == F.col("_is")) & (F.col("_part") == F.col("_ip")))
    placed = placed.select("doc_id", *keep, "size", "text_crc32", "shard", F.xxhash64("doc_id").alias("_u"), "_rid")
    return numbered(placed, ["shard"], [F.col("_u"), F.col("_rid")], n, "slot").select("doc_id", *keep, "size", "text_crc32", "shard", "slot")
