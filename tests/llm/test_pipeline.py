import re
from collections import Counter

import corpus_pipeline
from rankfile.llm.common import store

from .fixtures import SMALL, awkward, empty, table
from .test_models_similarity import brute_roots
from .test_pii_url import plain_risks, plain_sanitised
from .test_rules_pack_mix_shard import WORDS, brute_measures, brute_targets, check_pieces


def test_stages_against_brute_force(spark):
    docs = table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = store(stage(spark, docs, SMALL), "test-stage")
        assert out.columns == docs.columns and out.schema == docs.schema
        got = out.collect()
        if k == 0:
            m = {r["doc_id"]: brute_measures(r["text"]) for r in rows}
            want = [r for r in rows if m[r["doc_id"]][0] >= 50 and 100 * m[r["doc_id"]][4] <= 50 * m[r["doc_id"]][0]]
            assert Counter(got) == Counter(want)
        elif k == 1:
            sets = []
            for r in rows:
                w = re.findall(r"[^\x20\x09-\x0D]+", r["text"].lower())
                sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
            linked = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
            assert linked
            ids = [r["doc_id"] for r in rows]
            stay = {i for i, root in zip(ids, brute_roots(ids, linked)) if i == root}
            assert Counter(got) == Counter(r for r in rows if r["doc_id"] in stay)
        elif k == 2:
            risks = plain_risks(docs)
            want = {r["doc_id"]: plain_sanitised(r["text"], risks) for r in rows}
            assert any("<TERM>" in t for t in want.values())
            assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(rows)
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        else:
            size = Counter()
            for r in rows:
                size[r["source"]] += len(WORDS.findall(r["text"]))
            order = sorted(size)
            target = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
            taken, largest = Counter(), Counter()
            for r in got:
                taken[r["source"]] += len(WORDS.findall(r["text"]))
            for r in rows:
                largest[r["source"]] = max(largest[r["source"]], len(WORDS.findall(r["text"])))
            assert set(got) <= set(rows) and max(Counter(got).values()) <= 2
            assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
        docs, rows = out, got
    filled = check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect(), rows)
    assert filled > 0.97


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            docs = store(out, "test-odd")
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns


def test_run_is_the_chain(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 100
