"""Quality classifier: a linear-chain conditional random field labels lines good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store, texts
from .langid import train_split

#: Labelled documents (about) that the model is fitted on, and padded lines of a block of chains.
TRAIN_DOCS, BLOCK_LINES = 3000, 200_000
THRESHOLD = 0.7
_SYMBOLS = "#*$%&|<>"
_MARKS = ".,;:"
_UPPER = bytes(range(65, 91))
_OWN = 11
#: Own features of a line, of the lines before and after it, and a constant.
WIDTH = 3 * _OWN + 1


def line_features(lines: list[str]) -> np.ndarray:
    """Bounded measures of each line; characters are counted by whole-string passes."""
    out = np.zeros((len(lines), _OWN), dtype=np.float64)
    seen: set[str] = set()
    for k, line in enumerate(lines):
        words = line.split()
        n, chars = len(words), len(line)
        if not n:
            out[k, 0] = 1.0
            continue
        symbols = sum(map(line.count, _SYMBOLS))
        encoded = line.encode()
        digits = sum(map(encoded.count, b"0123456789"))
        out[k, 1] = min(1.0, n / 40)
        out[k, 2] = min(1.0, symbols / n)
        out[k, 3] = min(1.0, 5 * symbols / chars)
        out[k, 4] = min(1.0, 4 * digits / chars)
        out[k, 5] = (chars - len(encoded.translate(None, _UPPER)) if line.isascii() else sum(map(str.isupper, line))) / chars
        out[k, 6] = len(set(words)) / n
        out[k, 7] = min(1.0, line.count("!") / n)
        out[k, 8] = min(1.0, sum(map(line.count, _MARKS)) / n * 4)
        out[k, 9] = min(1.0, chars / n / 20)
        out[k, 10] = line in seen
        seen.add(line)
    return out


def chain_features(own: np.ndarray) -> np.ndarray:
    before = np.vstack((np.zeros((1, _OWN)), own[:-1]))
    after = np.vstack((own[1:], np.zeros((1, _OWN))))
    return np.hstack((own, before, after, np.ones((len(own), 1))))


@dataclass
class Crf:
    weights: np.ndarray  # WIDTH: score of `good` against `bad`
    change: np.ndarray  # 2 x 2 transition scores


def marginals(emit: np.ndarray, length: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions, and log Z, for padded chains (chains x lines) at once."""
    chains, most = emit.shape
    e = np.stack((np.zeros_like(emit), emit), axis=2)
    alpha = np.empty((chains, most, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, most):
        x = alpha[:, t - 1, :, None] + change[None]
        step = np.logaddexp(x[:, 0], x[:, 1]) + e[:, t]
        alpha[:, t] = np.where((t < length)[:, None], step, alpha[:, t - 1])
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    beta = np.zeros((chains, most, 2))
    pairs = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        on = t + 1 < length
        x = change[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(on[:, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
        p = np.exp(alpha[:, t, :, None] + x - log_z[:, None, None])
        pairs += p[on].sum(axis=0)
    good = np.exp(alpha[:, :, 1] + beta[:, :, 1] - log_z[:, None])
    return np.clip(good, 0, 1), pairs, log_z


def pad(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.asarray([len(c) for c in chains])
    out = np.zeros((len(chains), int(length.max())))
    for k, c in enumerate(chains):
        out[k, : len(c)] = c
    return out, length


def fit_chains(features: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.1, ridge: float = 0.01) -> Crf:
    """Maximum conditional likelihood by Adam; every line of a document carries the document's label.

    The likelihood is summed over documents in proportion to one over their lines, so that a long document counts as
    one, and both labels weigh alike in the line scores' intercept.
    """
    weights, change = np.zeros(WIDTH), np.array([[0.5, -0.5], [-0.5, 0.5]])
    theta = np.concatenate((weights, change.ravel()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    order = np.argsort([len(f) for f in features], kind="stable")
    blocks, k = [], 0
    while k < len(order):  # chains of like length together
        end = k + 1
        while end < min(len(order), k + 256) and (end - k + 1) * len(features[order[end]]) <= BLOCK_LINES:
            end += 1
        blocks.append(order[k:end])
        k = end
    stacked = []
    for block in blocks:
        fs = [features[i] for i in block]
        length = np.asarray([len(f) for f in fs])
        x = np.zeros((len(fs), int(length.max()), WIDTH))
        for k, f in enumerate(fs):
            x[k, : len(f)] = f
        stacked.append((x, length, labels[block].astype(float)))
    for step in range(1, rounds + 1):
        x, length, y = stacked[(step * 7919) % len(stacked)] if len(stacked) > 8 and step < rounds // 2 else (None, None, None)
        grad = np.zeros_like(theta)
        total = 0
        for x, length, y in [(x, length, y)] if x is not None else stacked:
            emit = x @ theta[:WIDTH]
            good, pairs, _ = marginals(emit, length, theta[WIDTH:].reshape(2, 2))
            on = (np.arange(x.shape[1])[None] < length[:, None]) / length[:, None]
            grad[:WIDTH] += np.einsum("ij,ijk->k", (y[:, None] - good) * on, x)
            moves = np.zeros((2, 2))
            moves[1, 1], moves[0, 0] = ((length - 1) * y).sum(), ((length - 1) * (1 - y)).sum()
            grad[WIDTH:] += (moves - pairs).ravel() / max(1.0, length.mean())
            total += len(length)
        grad = grad / total - ridge * np.concatenate((theta[:WIDTH] * 0.01, theta[WIDTH:]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def score_texts(batch: list[str], model: Crf) -> np.ndarray:
    """Each text's mean of P(good) over its lines, weighted by the lines' lengths (1 for an empty line)."""
    emits, sizes = [], []
    for text in batch:
        lines = text.split("\n")
        emits.append(chain_features(line_features(lines)) @ model.weights)
        sizes.append(np.asarray([len(x) + 1.0 for x in lines]))
    out = np.empty(len(batch))
    order = np.argsort([len(e) for e in emits], kind="stable")
    at = 0
    while at < len(order):  # chains of like length together, a bounded number of lines at once
        end = at + 1
        while end < len(order) and (end - at + 1) * len(emits[order[end]]) <= BLOCK_LINES:
            end += 1
        block = order[at:end]
        padded, length = pad([emits[i] for i in block])
        good, _, _ = marginals(padded, length, model.change)
        for k, i in enumerate(block):
            out[i] = float(np.dot(good[k, : length[k]], sizes[i]) / sizes[i].sum())
        at = end
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Crf:
    """Fits the field on about `train_docs` labelled documents of the training split, half of them of either label,
    chosen by a hash of doc_id (2 * train_docs ids at the very most), with all their lines. Documents are found by a
    broadcast join on the sample's ids; line features (44 bytes a line) are made on the executors."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & train_split(F.col("doc_id")))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    rate = F.coalesce(*[F.when(F.col("quality") == q, min(1.0, train_docs / 2 / n)) for q, n in counts.items()])
    share = F.pmod(F.xxhash64("doc_id", F.lit("crf")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(share < rate).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).dropDuplicates(["_id"])
    # its size is bounded, so it may be broadcast; texts are never shuffled for the sample's sake
    sample = F.broadcast(store(sample.orderBy(F.xxhash64("_id"), "_id").limit(2 * train_docs), "crf-sample"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_features(t.split("\n")).astype(np.float32).tobytes() for t in texts(batch, "text")]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "quality", "f"])

    rows = docs.join(sample, F.col("doc_id") == F.col("_id")).select(F.col("doc_id").cast("long"), "quality", "text").mapInArrow(features, "doc_id long, quality int, f binary")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("f").alias("f")).orderBy("doc_id").collect()  # a repeated doc_id counts once
    own = [np.frombuffer(r["f"], dtype=np.float32).reshape(-1, _OWN).astype(float) for r in rows]
    if not own:
        return Crf(np.zeros(WIDTH), np.zeros((2, 2)))
    return fit_chains([chain_features(f) for f in own], np.asarray([r["quality"] for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    score is the length-weighted mean of the lines' forward-backward marginals. Null text is one empty line. Without
    usable labels every score is 0.5. Labels that are null or other than 0 and 1 are not learned from; a document
    labelled twice counts once. Repeated rows get equal scores; an empty table gives no rows; other columns are not
    read. Nothing is shuffled in scoring; a task holds one batch of texts.
    """
    if model is None:
        model = fit(docs, labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(texts(batch, "text"), shared.value) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), (~train_split(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
