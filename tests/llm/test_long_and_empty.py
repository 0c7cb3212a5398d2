"""Very long texts through each operator, and each registered query over tables without rows."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfile.llm import crf, langid, mixing, packing, pii, quality_rules, queries, sharding, simhash

from .fixtures import SMALL, table
from .test_models_similarity import brute_print
from .test_pii_url import brute
from .test_rules_pack_mix_shard import WORDS, brute_measures, check_pieces

LONG = {
    1: " " * 1_000_000, 2: "\n" * 1_000_000, 3: "a" * 1_000_000, 4: "the word and " * 120_000, 5: "x" + " " * 400_000 + "y", 6: "1" * 1_000_000,
    7: " ".join(f"m{i}@x{i % 9}.org" for i in range(20_000)), 8: "line of text\n" * 60_000, 9: "\U0001d49c" * 300_000, 10: None, 11: "",
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(k, t, "en", "a", 1) for k, t in LONG.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).persist()


def test_packing_of_long_runs(long_docs):
    check_pieces(packing.pack(long_docs).collect(), long_docs.select("doc_id", "text").collect())


def test_long_texts_are_measured_whole(long_docs):
    got = {r["doc_id"]: r for r in quality_rules.judge(long_docs).collect()}
    for k, text in LONG.items():
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(text), k
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(long_docs).collect()}
    assert sizes == {k: len(WORDS.findall(t or "")) for k, t in LONG.items()}
    assert mixing.mixed_rows(long_docs).columns == long_docs.columns
    assert {r["doc_id"]: r["size"] for r in sharding.kd_shards(long_docs, 4).collect()} == {k: len((t or "").encode()) + 1 for k, t in LONG.items()}


def test_long_texts_are_labelled_and_scored(spark, long_docs):
    model = langid.fit(table(spark, "documents"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(long_docs, model).collect()}
    assert got[4] == "en" and {got[k] for k in (1, 2, 6, 10, 11)} == {"und"} and got[9] in model.langs
    scores = crf.score_quality(long_docs, table(spark, "labels"), crf.Crf(np.linspace(-1, 1, crf.WIDTH), np.array([[1.0, -1], [-1, 1]]))).collect()
    assert len(scores) == len(LONG) and all(0 <= r["score"] <= 1 for r in scores)


def test_long_texts_have_their_fingerprints(long_docs):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.classes(long_docs).collect()}
    assert got == {k: f"{brute_print(t):016x}" for k, t in LONG.items()}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(long_docs).collect()}
    assert kept == {1, 3, 4, 5, 6, 7, 8, 9}  # 2, 10 and 11 have no word either; 4 and 8 repeat other words


def test_many_matches(long_docs):
    got = {r["doc_id"]: r["spans"] for r in long_docs.select("doc_id", pii.base_spans(F.col("text")).alias("spans")).collect()}
    assert [k for k, spans in got.items() if spans] == [7]
    for k in (1, 5, 7, 9, 10, 11):  # the plain patterns take forever on the others
        assert [(s["kind"], s["start"], s["end"]) for s in got[k]] == brute(LONG[k]), k


def test_letters_of_all_code_points():
    points = np.asarray([c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000], dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in points.tolist()), dtype=bool)
    assert ((langid._lowered(points) != 0) == is_letter).all()
    model = langid.Model(["aa", "bb"], np.zeros((langid.PLACES, 2), dtype=np.float32), np.zeros((len(langid._NAMES), 2), dtype=np.float32))
    for text in ("\U0001d49c", "\U00010330\U00010400", "5 \U00020000"):
        assert langid.label(text, model)[0] == "aa"
    assert langid.label("\U000e0100 \U0001f600 12", model)[0] == langid.UNKNOWN


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("none")
    for name in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_over_empty_tables(spark, empty_tables, name):
    assert queries.queries()[name](spark, empty_tables).count() == 0


def test_pipeline_over_empty_tables(spark, empty_tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty_tables).count() == 0

