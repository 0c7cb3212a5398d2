"""Quality rules: per-document rules, and host verdicts from failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, small_batches, store

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host is rejected if its shrunk rate of failing documents is at least this.
HOST_LIMIT = 0.5
_METRICS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    k = len(known)
    if k >= 1 << 21:  # pairs first, so that codes stay within 63 bits
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1].astype(np.int64)
        code = pair[:-1] * k + ids[2:]
    else:
        code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(code)] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()  # bytes split at the six ASCII white-space characters
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeated_words(words)


def metrics(text: Column) -> Column:
    """The base measures as one struct; null text has none but zeros."""

    @F.arrow_udf(_METRICS)
    def of(column: pa.Array) -> pa.Array:
        rows = [measure(x.as_py() or "") for x in column]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    return of(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def host_verdicts(failures: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, n_failed, shrunk_rate, host_kept, from one row per document.

    The beta prior is fitted to the hosts' raw rates by moments (weighted by documents); with one host, or hosts alike
    beyond what counts explain, it is as strong as 1,000 documents. The null host is no host: it is always kept.
    """
    hosts = failures.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = store(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n")
    # moments: mean m, and the between-host variance left after the binomial share
    s = hosts.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * rate * rate).alias("nrr")).first()
    if not s["n"]:
        mean, strength = 0.0, 1.0
    else:
        mean = s["f"] / s["n"]
        inner, spread = mean * (1 - mean), s["nrr"] - s["n"] * mean * mean
        freedom = s["n"] - s["nn"] / s["n"]
        between = (spread - (s["k"] - 1) * inner) / freedom if freedom > 0 else 0.0
        strength = min(1000.0, max(1.0, inner / between - 1)) if between > 0 else 1000.0
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", "n", "n_failed", shrunk.alias("shrunk_rate"), (F.col("host").isNull() | (shrunk < limit)).alias("host_kept"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, host_rate, kept.

    A document is dropped if it fails the base rules or its host (column source) is rejected. The measures are taken
    once and stored without the texts; host counts combine before the shuffle, and verdicts (a row a host) are joined
    back on narrow rows. Null text fails by length; texts of any length are measured whole. Repeated rows count and are judged as rows of their own.
    An empty table gives no rows; further columns are left out.
    """
    small_batches(docs.sparkSession)
    m = F.col("m")
    measured = docs.select("doc_id", F.col("source").alias("_host"), metrics(F.col("text")).alias("m")).select("doc_id", "_host", "m.*", base_failed(m).alias("base_failed"))
    measured = store(measured, "measures")
    hosts = host_verdicts(measured, "_host", "base_failed", limit)
    out = measured.join(hosts, F.col("_host").eqNullSafe(F.col("host")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("shrunk_rate").alias("host_rate"), (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep_documents(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of `docs` (all their columns) that judge() keeps, repeated rows each. Texts are measured a second time
    beside the host verdicts, which the first pass needs whole; they are shuffled only where the list of rejected hosts
    is too large for the planner to broadcast it."""
    small_batches(docs.sparkSession)
    failed = docs.select(F.col("source").alias("_host"), base_failed(metrics(F.col("text"))).alias("_failed"))
    hosts = host_verdicts(failed, "_host", "_failed", limit)
    bad = hosts.where(~F.col("host_kept")).select(F.col("host").alias("_bad"))
    rest = docs.join(bad, F.col("source") == F.col("_bad"), "left_anti")
    return rest.where(~base_failed(metrics(F.col("text")))).select(*docs.columns)
