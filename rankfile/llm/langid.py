"""Language ID: scripts narrow the candidates, Viterbi over per-word scores labels spans of mixed text."""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Hash places of character trigrams.
PLACES = 1 << 15
#: Labelled documents a language that the model is fitted on, at most about so many (chosen by a hash of doc_id).
TRAIN_DOCS = 600
#: Log-odds that a change of language must gain.
SWITCH = 12.0
#: Characters scored at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: (first code point, script), by code point.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_FIRST = np.asarray([a for a, _ in SCRIPTS])
_NAMES = sorted({s for _, s in SCRIPTS})
_CODE = np.asarray([_NAMES.index(s) for _, s in SCRIPTS])


def script_of(char: str) -> str:
    return SCRIPTS[bisect.bisect_right([a for a, _ in SCRIPTS], ord(char)) - 1][1]


def _letters(first: int, end: int) -> np.ndarray:
    """The lower-case code point of each letter from `first` up to `end`; 0 for what is no letter."""
    out = np.zeros(end - first, dtype=np.uint32)
    for c in range(first, end):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c - first] = ord(low) if len(low) == 1 else c
    return out


#: Letters below U+10000 and, once a text has any beyond, of all code points.
_TABLE: list[np.ndarray] = []


def _lowered(raw: np.ndarray) -> np.ndarray:
    """The lower-case letter of each code point; 0 for what is no letter."""
    if not _TABLE:
        _TABLE.append(_letters(0, 0x10000))
    if len(raw) and raw.max() >= len(_TABLE[0]):
        _TABLE[0] = np.concatenate((_TABLE[0], _letters(0x10000, sys.maxunicode + 1)))
    return _TABLE[0][raw]


@dataclass
class Words:
    """A text's letter runs: ends of their trigrams, places of trigrams, first letters, bounds in the text."""

    places: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray


def words_of(text: str) -> Words:
    """Letter runs; each letter heads a trigram of its predecessor, itself and its successor (0 beyond the run)."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = _lowered(raw)
    at = np.flatnonzero(low)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none, none)
    pad = np.concatenate((np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)))
    code = pad[at] * np.uint32(0x9E3779B1) + pad[at + 1] * np.uint32(0x85EBCA77) + pad[at + 2] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    places = (code * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    last = np.append(first[1:], len(at)) - 1
    script = _CODE[np.searchsorted(_FIRST, raw[at[first]], side="right") - 1]
    return Words(places, first, at[first], at[last] + 1, script)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # PLACES x langs
    allowed: np.ndarray  # scripts x langs: 0, or a penalty for a language that does not use the script

    def scores(self, w: Words) -> np.ndarray:
        per_word = np.add.reduceat(self.logp[w.places], w.first, axis=0) if len(w.first) else np.zeros((0, len(self.langs)))
        return per_word + self.allowed[w.script]


def train_split(doc_id: Column) -> Column:
    """True where labels may be learned from: crc32 of the doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram log-probabilities of each language (add-one), from whole texts of a hash-chosen sample.

    docs: doc_id, text, lang, already limited to rows that may be learned from. The sample's bound is `train_docs`
    documents a language in expectation. Counts are summed on the executors; the driver gets PLACES rows a language.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((PLACES, 0), dtype=np.float32), np.zeros((len(_NAMES), 0), dtype=np.float32))
    rate = F.coalesce(*[F.when(F.col("lang") == lang, min(1.0, train_docs / n)) for lang, n in counts.items()])
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                held = sums.setdefault(lang, np.zeros(PLACES + len(_NAMES), dtype=np.int64))
                for k in range(0, len(text), CHUNK):
                    w = words_of(text[k : k + CHUNK])
                    held[:PLACES] += np.bincount(w.places, minlength=PLACES)
                    held[PLACES:] += np.bincount(w.script, minlength=len(_NAMES))
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], names=["lang", "place", "n"])

    rows = known.where(share < rate).select("lang", "text").mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((PLACES + len(_NAMES), len(langs)))
    table[rows["place"].to_numpy(), rows["lang"].map(langs.index).to_numpy()] = rows["n"].to_numpy()
    grams, scripts = table[:PLACES] + 0.5, table[PLACES:]
    logp = np.log(grams / grams.sum(axis=0))
    used = scripts / np.maximum(scripts.sum(axis=0), 1) >= 0.01
    # a script that no language uses narrows nothing
    allowed = np.where(used | ~used.any(axis=1, keepdims=True), 0.0, -1e3)
    # only differences between languages matter
    return Model(langs, (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32), allowed.astype(np.float32))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word: the sum of scores less `switch` for each change is largest.

    One language throughout is best if no stretch gains over half of `switch` by another; that is tested first. A
    path with n stretches off the best language gains at most n * switch / 2 by them and pays n - 1 changes at least
    (n if it ever uses the best language), so it cannot win.
    """
    n, _ = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(np.vstack((np.zeros_like(gain[:1]), gain[:-1])), axis=0), 0)
    if (gain - low).max() <= switch / 2:
        return np.full(n, best)
    # few languages and a short step: plain lists beat arrays
    rows = scores.tolist()
    v, langs = rows[0], range(len(rows[0]))
    back: list[list[int] | None] = []
    for row in rows[1:]:
        top = max(v)
        jump = top - switch
        if min(v) >= jump:
            back.append(None)  # all stay
            v = [a + b for a, b in zip(v, row)]
        else:
            at = v.index(top)
            back.append([k if v[k] >= jump else at for k in langs])
            v = [(a if a >= jump else jump) + b for a, b in zip(v, row)]
    path = np.empty(n, dtype=np.int64)
    state = path[-1] = v.index(max(v))
    for t in range(n - 2, -1, -1):
        if back[t] is not None:
            state = back[t][state]
        path[t] = state
    return path


def label(text: str, model: Model, switch: float = SWITCH) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, its share of the letters, and spans (start, end, language) in code points."""
    parts: list[tuple[Words, np.ndarray, int]] = []
    k = 0
    while k < len(text):
        end = min(len(text), k + CHUNK)
        while end < len(text) and end < k + 2 * CHUNK and text[end].isalpha():  # not within a word
            end += 1
        w = words_of(text[k:end])
        if len(w.first):
            parts.append((w, model.scores(w), k))
        k = end
    if not parts or not model.langs:
        return UNKNOWN, 0.0, []
    path = viterbi(np.concatenate([s for _, s, _ in parts]), switch)
    start = np.concatenate([w.start + k for w, _, k in parts])
    end = np.concatenate([w.end + k for w, _, k in parts])
    letters = np.bincount(path, weights=end - start, minlength=len(model.langs))
    turn = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    spans = [(int(start[a]), int(end[b - 1]), model.langs[path[a]]) for a, b in zip(turn, np.append(turn[1:], len(path)))]
    top = int(letters.argmax())
    if len(spans) > 2 and path[0] == path[-1]:  # a text that goes back to the language it began in only quotes the other
        top = int(path[0])
    return model.langs[top], float(letters[top] / letters.sum()), spans


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model | None = None, switch: float = SWITCH) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, spans.

    Without a model one is fitted on the rows that train_split() allows. Nothing but the text enters a prediction.
    lang_pred has the most letters in its spans (ties: the first by name), but a text of three spans or more that ends
    in the language it began in has that one, what is between is a quotation; score is its share of the letters; null
    texts and texts without letters are `und` with score 0 and no spans, as is everything if no row has a label.
    Repeated rows get equal results; an empty table gives no rows; other columns are not read. Each task holds one
    batch and the model (PLACES floats a language); nothing is shuffled.
    """
    if model is None:
        model = fit(docs.where(train_split(F.col("doc_id"))).select("doc_id", "text", "lang"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            found = [label(t, shared.value, switch) for t in texts(batch, "text")]
            spans = pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], kind)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), (~train_split(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(run, SCHEMA)
