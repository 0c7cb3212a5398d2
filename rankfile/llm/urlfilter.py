"""URL filter: a blocked Bloom filter of listed hosts and paths passes possible hits to an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, row_columns

#: Most 64-bit blocks that the filter takes (8 MB as a literal, for some 4 million rules); beyond it ever more keys pass
#: on to the join, which decides.
MAX_BLOCKS = 1 << 20
#: Bits set for each key within its block.
PROBES = 4


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _mask(h: Column) -> Column:
    """The key's bits within its 64-bit block, from other bits of the hash."""
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 20 + 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules as a table, made of literals."""
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action")) for rule, action in rules])
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("action"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to `pages`.

    rules: (rule, action); a rule is `host/path-prefix` (no /: all of the host). It fits its host and all subdomains if the url's path
    starts with /path-prefix; the longest rule wins (then the smaller string; a rule listed with several actions
    takes `block` before `allow`). Where no rule fits, rule is null and verdict is `default`.

    A url's candidate keys are its host's suffixes joined with its path's prefixes of the lengths that rules have.
    The Bloom filter (one block of 64 bits a key, built by bit_or, passed to the scan as a scalar subquery, an array of at
    most MAX_BLOCKS longs that grows with the list) drops nearly all keys as they are made; those left meet the list in an exact
    equality join, which removes false positives. Distinct (host, path prefix) probes are joined once, so a host with
    a third of all pages adds one probe a task. Null urls and urls without :// have an empty host, which fits no rule.
    Repeated rows each get their verdict; urls of any length are read whole; an empty table gives no rows; other columns of `pages` pass through, but columns named host, path, rule
    or verdict are replaced. An empty rule list gives `default` for all.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    listed = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max("action").alias("action"))  # block > allow
    # a rule without a path is its host's, as if it ended in /
    whole = F.when(F.instr("rule", "/") > 0, F.col("rule")).otherwise(F.concat("rule", F.lit("/")))
    listed = listed.withColumn("_key", whole).withColumn("_h", F.xxhash64("_key"))
    # what is known of the list is of bounded size: its count and its rules' path and host depths
    facts = listed.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.length("_key") - F.instr("_key", "/"))).alias("lengths"),
    ).first()
    blocks = 1
    while blocks < min(MAX_BLOCKS, max(1, facts["n"] // 4)):
        blocks *= 2
    words = listed.groupBy(_block(F.col("_h"), blocks).alias("b")).agg(F.bit_or(_mask(F.col("_h"))).alias("w"))
    # all blocks in order, so that a probe is one look at its place
    every = words.union(rules.sparkSession.range(blocks).select(F.col("id").cast("int"), F.lit(0).cast("long"))).groupBy("b").agg(F.bit_or("w").alias("w"))
    bits = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("m")).scalar()

    pages = pages.drop("host", "path", "rule", "verdict")
    rows = apart(pages, host.alias("host"), path.alias("path"))
    parts = F.split(F.col("_host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length("_lead") > n, F.substring("_lead", 1, n + 1)) for n in facts["lengths"]]) if facts["lengths"] else F.array().cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))

    longest = max(facts["lengths"] or [0]) + 1
    lead = F.substring(F.col("path"), 1, longest)
    probes = rows.where((F.col("host") != "") & F.col("path").startswith("/")).select(F.col("host").alias("_host"), lead.alias("_lead")).distinct()

    def possible(k: Column) -> Column:
        h = F.xxhash64(k)
        word = F.element_at(bits, _block(h, blocks) + 1)
        return word.bitwiseAND(_mask(h)) == _mask(h)

    hits = probes.withColumn("_key", F.explode(keys)).where(possible(F.col("_key"))).join(listed.drop("_h"), "_key")
    best = hits.groupBy("_host", "_lead").agg(F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "rule")).alias("_best"))
    out = rows.withColumn("_path_lead", lead).join(best, (F.col("host") == F.col("_host")) & (F.col("_path_lead") == F.col("_lead")), "left")
    return out.select(
        *row_columns(pages),
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
    )
