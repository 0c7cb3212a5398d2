import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankfile.llm import ann, crf, langid, simhash

from .fixtures import awkward, empty, same, table

MID = "/root/testdata/sf0.01"


def test_language_id(spark):
    docs = table(spark, "documents", MID)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(got[r["doc_id"]]["held_out"] for r in held) == len(held) == sum(r["held_out"] for r in got.values())
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    model = langid.fit(docs)
    en, fr = docs.where("lang = 'en'").first()["text"][:600], docs.where("lang = 'fr'").first()["text"][:600]
    lang, score, spans = langid.label(en + "\n" + fr, model)
    assert [s[2] for s in spans] == ["en", "fr"] and abs(spans[1][0] - len(en)) < 60 and 0.3 < score < 0.9
    odd = {r["doc_id"]: r for r in langid.identify(awkward(spark), model).collect()}
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[0]["score"] == 0
    assert langid.identify(empty(spark), model).count() == 0 and langid.identify(empty(spark)).count() == 0
    none = langid.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for scale in (0.5, 3, 9):
        for _ in range(60):
            s = rng.normal(size=(7, 3)) * scale
            s[:3, 0] += scale
            path = langid.viterbi(s, 4.0)
            total = lambda p: s[np.arange(7), p].sum() - 4.0 * (np.diff(p) != 0).sum()
            best = max(total(np.asarray(p)) for p in np.ndindex(3, 3, 3, 3, 3, 3, 3))
            assert total(path) == pytest.approx(best)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    change = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 4, 6)]
    emit, length = crf.pad(chains)
    good, _, log_z = crf.marginals(emit, length, change)
    for k, e in enumerate(chains):
        weight = {}
        for p in np.ndindex(*[2] * len(e)):
            p = np.asarray(p)
            weight[tuple(p)] = np.exp((e * p).sum() + change[p[:-1], p[1:]].sum())
        z = sum(weight.values())
        assert log_z[k] == pytest.approx(np.log(z))
        for t in range(len(e)):
            assert good[k, t] == pytest.approx(sum(w for p, w in weight.items() if p[t]) / z)


def test_quality_classifier(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    got = crf.score_quality(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    assert ((held["quality"] == held["predicted"]).mean()) > 0.95
    odd = crf.score_quality(awkward(spark), labels.select(F.col("doc_id"), F.lit(None).cast("int").alias("quality")))
    assert odd.count() == awkward(spark).count() and odd.where("score <> 0.5").count() == 0
    assert crf.score_quality(empty(spark), labels, crf.Crf(np.zeros(crf.WIDTH), np.zeros((2, 2)))).count() == 0


def brute_print(text, size=4):
    import re

    lower = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_classes(spark):
    for docs in (awkward(spark).where("doc_id IS NOT NULL"), table(spark, "documents")):
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
        prints = [brute_print(r["text"]) for r in rows]
        linked = [(i, j) for j in range(len(rows)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
        roots = brute_roots([r["doc_id"] for r in rows], linked)
        same(simhash.classes(docs).collect(), [(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, roots)])
    assert simhash.classes(empty(spark)).count() == 0
    odd = simhash.classes(awkward(spark)).where("doc_id IS NULL").collect()
    assert len(odd) == 1 and odd[0]["component_id"] is None


@pytest.mark.parametrize("dense", [4, 48])
def test_all_links_are_found(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    prints = set(int(x) for x in seeds)
    for s in seeds[:12]:
        x = int(s)
        for _ in range(12):
            for b in rng.choice(64, size=int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    linked = [(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 4]
    keys = simhash.signatures(np.asarray(prints, dtype=np.uint64), simhash.segments_for(4))
    ids = np.repeat(np.arange(len(prints)), keys.shape[1])
    a, b = simhash.links_in_order(keys.ravel(), ids, np.repeat(np.asarray(prints, dtype=np.uint64), keys.shape[1]), 4)
    want = brute_roots(range(len(prints)), linked)
    assert brute_roots(range(len(prints)), list(zip(a.tolist(), b.tolist()))) == want
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert [got.get(i, i) for i in range(len(prints))] == want


def test_near_duplicates_by_similarity(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, size=6)) for _ in range(4000)]
    rows, copies = [], 0
    for k in range(60):
        words = [vocabulary[int(i)] for i in rng.integers(0, 4000, size=300)]
        rows.append((len(rows), " ".join(words)))
        if k < 25:
            changed = list(words)
            for i in rng.choice(290, size=4, replace=False):
                changed[int(i)] = "changed"
            rows.append((len(rows), "\n".join(changed)))
            copies += 1
        if k == 30:
            for j in range(80):  # a dense group
                changed = list(words)
                changed[j * 3] = f"x{j}"
                rows.append((len(rows), " ".join(changed)))
                copies += 1
    rows += [(900, None), (901, ""), (902, " "), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "'y' AS _id")
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    linked = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    order = [r[0] for r in rows]
    want = {(r, order[i]) for i, r in enumerate(brute_roots(order, linked))}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r for r, _ in want})
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_block_edits_and_chains_are_found(spark, monkeypatch):
    """Appended, cut and replaced stretches at a similarity of 0.80 to 0.90, and chains of them, against all pairs."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, size=5))
    rows = []
    for k in range(150):
        n = int(rng.integers(60, 400))
        words = [word() for _ in range(n)]
        rows.append(words)
        for _ in range(3):
            m = int(n * rng.uniform(0.11, 0.26))
            kind = int(rng.integers(0, 4))
            words = rows[-1] if kind == 3 else rows[-1 - (len(rows) - 1) % 4]
            m = min(m, len(words) // 4)
            new = [word() for _ in range(m)]
            rows.append(words + new if kind == 0 else words[:-m] if kind == 1 else words[: m // 2] + new[: m // 2] + words[m // 2 * 2 :] if kind == 2 else new[: m // 2] + words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    near = [(i, j) for j in range(len(rows)) for i in range(max(0, j - 4), j) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum(jaccard(sets[i], sets[j]) < 0.85 for i, j in near) > 60
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    want = sorted({r for r in brute_roots(range(len(rows)), near)})
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


@pytest.mark.parametrize("texts_a_block", [3, 4096])
def test_large_cells_in_blocks(spark, monkeypatch, texts_a_block):
    """One passage in all texts, groups of near copies beside it: blocks of any size give the same groups."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", texts_a_block)
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, size=5))
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(12):
        own = [word() for _ in range(20)]
        for _ in range(4):
            words = passage + own
            for i in rng.choice(len(words), size=int(rng.integers(0, 3)), replace=False):
                words[int(i)] = word()
            rows.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    linked = [(i, j) for j in range(len(rows)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)] + [(99, "one two")], "doc_id long, text string")
    want = sorted({*brute_roots(range(len(rows)), linked), 99})
    assert 12 < len(want) < 46
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == want


def test_spanning_links_join_what_all_links_join():
    rng = np.random.default_rng(10)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, size=40, dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 14))):
            own = base.copy()
            own[rng.choice(40, size=int(rng.integers(0, 9)), replace=False)] = rng.integers(0, 1 << 60, dtype=np.uint64)
            sets.append(np.unique(own))
        all_links = [(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        links, _ = simhash.spanning_links(sets, 0.8)
        assert brute_roots(range(len(sets)), links) == brute_roots(range(len(sets)), all_links) and len(links) < len(sets)


def test_signatures_of_places_meet_at_the_similarity():
    rng = np.random.default_rng(11)
    met, signed = 0, 0
    for _ in range(2000):
        base = rng.integers(0, 1 << 63, size=90, dtype=np.uint64)
        other = np.concatenate((base[:80], rng.integers(0, 1 << 63, size=10, dtype=np.uint64)))  # similarity 0.8
        a, b = simhash.least_places(base), simhash.least_places(other)
        signed += (a == b).mean()
        met += bool(np.intersect1d(simhash.place_signatures(a), simhash.place_signatures(b)).size)
    assert met == 2000 and abs(signed / 2000 - 0.8) < 0.01


def brute_nearest(rows, queries, k):
    rows = sorted(set(rows))
    x = np.asarray([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        v = np.asarray(q[1], dtype=np.float32).astype(np.float64)
        scores = (x * v).sum(axis=1)
        ranked = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows) if i != q[0])
        out[q[0]] = [(i, -s) for s, i in ranked[:k]]
    return out


def test_nearest_recall_and_scores(spark):
    df = table(spark, "embeddings", "/root/testdata/sf0.1")
    rows = [(r["vec_id"], tuple(r["embedding"])) for r in df.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) > 0.97


def test_nearest_awkward(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(40, [1.0, 0.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    odd = [(60, None), (61, []), (80, [0.0] * 4), (62, [1.0, None, 1.0, 1.0]), (63, [1.0, float("nan"), 1.0, 1.0]), (64, [float("inf"), 0.0, 1.0, 1.0]), (200, [5.0, 5.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS shard", "3 AS q")
    good = [(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None]
    want = brute_nearest(good, [r for r in set(good) if r[0] % 20 == 0], 20)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))
    assert ann.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
