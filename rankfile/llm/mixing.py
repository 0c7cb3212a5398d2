"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, numbered, ranked, row_columns, store

#: Words of the remaining budget that the dynamic programme fits exactly.
DP_WORDS = 1 << 16
#: Rows (source, length) of a plan that may be broadcast to the texts; a larger one is joined by a shuffle.
PLAN_ROWS = 500_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near below `budget` as can be.

    The bulk goes in proportion to the counts. What that leaves is filled from the longest length down while it is over
    DP_WORDS, by documents that fit, and then by a bounded-knapsack dynamic programme (binary-split counts, first item
    that reaches each sum): the best sum that the documents not taken yet can add. Products are Python integers.
    """
    size, n = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(a * b for a, b in zip(size, n))
    if budget <= 0 or total == 0:
        return np.zeros(len(size), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    take = [k * budget // total for k in n]
    left = budget - sum(a * b for a, b in zip(size, take))
    order = [i for i in sorted(range(len(size)), key=lambda i: -size[i]) if size[i] > 0]
    for i in order:  # far from the budget any document that fits is right
        if left <= DP_WORDS:
            break
        k = min(n[i] - take[i], (left - DP_WORDS) // size[i] + 1, left // size[i])
        take[i] += k
        left -= k * size[i]
    left = min(left, sum(a * (b - c) for a, b, c in zip(size, n, take)))
    reach = np.zeros(left + 1, dtype=bool)
    reach[0] = True
    via = np.full(left + 1, -1, dtype=np.int64)
    chunks: list[tuple[int, int]] = []
    for i in order:
        rest, k = min(n[i] - take[i], left // size[i]), 1
        while rest and not reach[left]:
            k = min(k, rest)
            w = k * size[i]
            new = reach[: left + 1 - w] & ~reach[w:]
            at = np.flatnonzero(new) + w
            if len(at):
                reach[at] = True
                via[at] = len(chunks)
                chunks.append((i, k))
            rest -= k
            k *= 2
    s = int(np.flatnonzero(reach)[-1])
    while s:
        i, k = chunks[via[s]]
        take[i] += k
        s -= k * size[i]
    return np.asarray(take, dtype=np.int64)


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    size, n, target, total = pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    passes = int(target // total) if total else 0
    budget = min(int(round(target - passes * total)), total)
    return pdf.assign(passes=np.int64(passes), take=fit_budget(size, n, budget))


def goals(hist: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target for each source of `hist` (source, size, n).

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes; a target stops at `cap`
    times its source's size and the excess is shared anew by weight. Sources are ranked by ranges, and each round of
    sharing is one aggregate, so that they may be many; the driver sees sums only.
    """
    sums = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    weighed = store(ranked(sums, "source", "_place").select("source", "source_size", weight.alias("w")), "mix-weights")
    capped = F.col("source_size") * F.lit(float(cap))
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("w") > capped
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, capped).otherwise(0.0)).alias("spent"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(over).alias("full")).first()
        if r["full"] == full or not r["w"]:
            break
        full, level = r["full"], (share * r["all"] - r["spent"]) / r["w"]
    return weighed.select("source", "source_size", F.least(capped, F.lit(level or 0.0) * F.col("w")).alias("target"))


def _planned(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` as (doc_id, source, size, _u, _rid, _rank), and for each (source, size) what is to be taken."""
    narrow = store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("_u"), F.monotonically_increasing_id().alias("_rid")), "mix")
    rows = narrow.count()
    hist = store(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist", rows)
    g = goals(hist, weights, share, cap).withColumnRenamed("source", "_s")
    plan = hist.join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").groupBy("source")
    plan = plan.applyInPandas(_plan, "source string, size long, n long, source_size long, target double, passes long, take long")
    plan = store(plan.withColumnsRenamed({"source": "_source", "size": "_size"}), "mix-plan", rows)
    return numbered(narrow, ["source", "size"], [F.col("_u"), F.col("_rid")], rows, "_rank"), plan


def _draw(seed: int):
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _same_length():
    return F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, times.

    Targets are goals(). A source's documents are all taken floor(target / source_size) times; the rest of the target
    is fitted by fit_budget() over the counts of each exact length (a task holds one source's lengths, a row each), and
    which documents of a length are taken again is decided by a seeded hash of doc_id and text, so reruns agree.
    Null text has size 0 and is never taken; texts of any length are counted whole. Ranks within (source, length) are
    by salted buckets, so one length or source may hold any share of the rows. Repeated rows are ranked as rows of their
    own, in any order among themselves; other columns are left out; an empty table gives no rows.
    """
    rows_ranked, plan = _planned(docs, weights, share, cap, seed)
    out = rows_ranked.join(plan, _same_length())
    times = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("passes") + (F.col("_rank") < F.col("take")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix as rows: each row of `docs` (all its columns) as often as mix() takes it.

    The documents of a length that are taken again are those of the least hashes, so each text is decided where it is
    read, by its (source, length)'s greatest hash taken; this plan, a row for each (source, length), is broadcast up to
    PLAN_ROWS rows. Only rows that share that hash with one not taken (repeated rows) are ranked, by a hash of the row.
    """
    rows_ranked, plan = _planned(docs, weights, share, cap, seed)
    edge = rows_ranked.join(plan, _same_length()).where("size > 0")
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_u")))
    edges = edge.groupBy("_source", "_size").agg(F.max("passes").alias("_passes"), F.max("take").alias("_take"), at(F.col("take") - 1).alias("_last"), at(F.col("take")).alias("_next"))
    edges = store(edges, "mix-edges", 1)
    rows = apart(docs, "source", word_count(F.col("text")).alias("size"), _draw(seed).alias("_u"))
    few = F.broadcast(edges) if edges.count() <= PLAN_ROWS else edges
    met = rows.join(few, _same_length())
    cut = F.coalesce(F.col("_last") == F.col("_next"), F.lit(False)) & (F.col("_u") == F.col("_last"))
    times = F.col("_passes") + F.coalesce(F.col("_u") <= F.col("_last"), F.lit(False)).cast("long")
    each = lambda df: df.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*row_columns(docs))
    out = each(met.where(~cut).withColumn("_times", times).where("_times > 0"))
    if edges.where("_last = _next").isEmpty():
        return out
    first = rows_ranked.join(edges.where("_last = _next"), _same_length() & (F.col("_u") == F.col("_last"))).groupBy("_source", "_size").agg(F.min("_rank").alias("_first"))
    again = met.where(cut).withColumn("_nth", F.row_number().over(Window.partitionBy("_source", "_size").orderBy(F.xxhash64("_row"))))
    first = first.withColumnsRenamed({"_source": "_fs", "_size": "_fz"})
    again = again.join(first, F.col("_source").eqNullSafe(F.col("_fs")) & (F.col("_size") == F.col("_fz")))
    again = again.withColumn("_times", F.col("_passes") + (F.col("_nth") <= F.col("_take") - F.col("_first")).cast("long")).where("_times > 0")
    return out.union(each(again))
