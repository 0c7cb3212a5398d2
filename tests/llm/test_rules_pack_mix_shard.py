import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from rankfile.llm import mixing, packing, quality_rules, sharding

from .fixtures import awkward, awkward_rows, empty, same, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dups, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORDS.search(x):
            dups += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_measures(spark):
    for docs in (awkward(spark), table(spark, "documents")):
        got = quality_rules.judge(docs)
        rows = docs.select("doc_id", "text").collect()
        want = []
        for r in rows:
            m = brute_measures(r["text"])
            want.append((r["doc_id"], *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
        same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
        assert got.where("base_failed and kept").count() == 0


def test_bad_host_goes_and_clean_host_stays(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, good, None, f"ok{i % 5}", 1) for i in range(200)] + [(1000 + i, good if i < 5 else "bad", None, "junk", 1) for i in range(100)]
    rows += [(5000 + i, "bad", None, None, 1) for i in range(9)] + [(6000, good, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert kept == set(range(200)) | {6000}
    assert {r["doc_id"] for r in quality_rules.keep_documents(docs).collect()} == kept
    assert quality_rules.keep_documents(docs).columns == docs.columns
    assert quality_rules.judge(empty(spark)).count() == 0 and quality_rules.keep_documents(empty(spark)).count() == 0


@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_is_the_tightest(lengths):
    seq, off = packing.best_fit_decreasing(np.asarray(lengths, dtype=np.int64), 30)
    room: dict[int, int] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = [c for c in room.values() if c >= n]
        if fits:
            assert room[seq[i]] == min(fits)
        else:
            assert seq[i] not in room
            room[seq[i]] = 30
        assert off[i] == 30 - room[seq[i]]
        room[seq[i]] -= n


def check_pieces(rows, docs, window=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs:
        ids = np.asarray(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for s in range(0, len(ids), window):
            want[(r["doc_id"], s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sum(n for s in sequences.values() for _, n in s) / (window * len(sequences))


def test_packing(spark):
    for docs in (awkward(spark), table(spark, "documents")):
        filled = check_pieces(packing.pack(docs).collect(), docs.select("doc_id", "text").collect())
    assert filled > 0.98
    check_pieces(packing.pack(docs.repartition(1), pending=50).collect(), docs.select("doc_id", "text").collect())
    assert packing.pack(empty(spark)).count() == 0
    parts = docs.repartition(60)  # as of many small files
    filled = check_pieces(packing.pack(parts).collect(), docs.select("doc_id", "text").collect())
    assert filled > 0.98


@given(st.lists(st.integers(1, 30), max_size=80))
def test_best_fit_by_counts_places_each_piece_once(lengths):
    counts, held, placed = Counter(lengths), {}, set()
    for length, at, n, of, first, offset in packing.best_fit_by_counts(counts, 30):
        for k in range(n):
            host = (of, first + k)
            assert offset == held.get(host, 0) and (offset or host == (length, at + k))
            held[host] = offset + length
            placed.add((length, at + k))
    assert placed == {(z, k) for z, n in counts.items() for k in range(n)} and sum(held.values()) == sum(lengths)
    assert all(z <= 30 for z in held.values()) and sum(z <= 15 for z in held.values()) <= 1
    one_by_one, _ = packing.best_fit_decreasing(np.asarray(lengths, dtype=np.int64), 30)
    assert len(held) <= 1.25 * len(set(one_by_one.tolist())) + 1


def test_overlong_document_and_tiny_windows(spark):
    rows = [(i, "word " * (i % 7)) for i in range(300)] + [(900, "many words " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    got = packing.pack(docs)
    assert check_pieces(got.collect(), docs.collect()) > 0.7 and got.select("sequence_id").distinct().count() <= 5


def brute_targets(sizes, weights, share, cap):
    out, pool, free = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if pool * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = pool * weights[i] / w
            return out
        for i in over:
            out[i] = cap * sizes[i]
            pool -= out[i]
        free = [i for i in free if i not in over]
    return out


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_budget_is_fitted_as_well_as_can_be(items, budget):
    lengths, counts = (np.asarray(x, dtype=np.int64) for x in zip(*items))
    take = mixing.fit_budget(lengths, counts, budget)
    assert ((0 <= take) & (take <= counts)).all()
    total = int((take * lengths).sum())
    reach = {0}
    for n, c in items:
        reach |= {s + n * k for s in reach for k in range(c + 1)}
    best = max(s for s in reach if s <= max(0, budget))
    assert total <= budget and best - total <= max(lengths)  # the bulk goes in proportion, the rest is exact


def test_mix(spark):
    for docs in (awkward(spark), table(spark, "documents")):
        rows = mixing.mix(docs).collect()
        src = docs.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in src:
            size[r["source"]] += len(WORDS.findall(r["text"] or ""))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        target = dict(zip(order, brute_targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
        same([(r["doc_id"], r["source"], r["size"], r["source_size"]) for r in rows], [(r["doc_id"], r["source"], len(WORDS.findall(r["text"] or "")), size[r["source"]]) for r in src])
        taken, largest = Counter(), Counter()
        for r in rows:
            assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        for s in order:
            assert abs(taken[s] - target[s]) <= max(1, largest[s])
        same(rows, mixing.mix(docs.repartition(3)).collect() if docs.select("doc_id").distinct().count() == docs.count() else rows)
        repeated = mixing.mixed_rows(docs)
        assert repeated.columns == docs.columns
        assert sum(len(WORDS.findall(r["text"] or "")) for r in repeated.collect()) == sum(taken.values())
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0


def test_budget_of_a_large_corpus():
    lengths, counts, budget = np.array([10, 20, 30]), np.array([4 * 10**9, 10**9, 2 * 10**9]), 9 * 10**10
    take = mixing.fit_budget(lengths, counts, budget)
    assert (take * lengths).sum() == budget and (np.abs(take - counts * 0.75) <= 10).all()
    lengths, counts = np.arange(1, 3001) * 7, np.full(3000, 10**12, dtype=np.int64) // np.arange(1, 3001)
    budget = int((lengths * counts).sum()) // 3 + 12345
    take = mixing.fit_budget(lengths, counts, budget)
    assert ((0 <= take) & (take <= counts)).all() and 0 <= budget - int((take * lengths).sum()) < 7
    assert (np.abs(take - counts * (budget / int((lengths * counts).sum()))) <= 1e-6 * counts + 10_000).all()


@pytest.mark.parametrize("n", [2, 40])
def test_goals_of_many_sources(spark, n):
    rng = np.random.default_rng(n)
    sizes = {f"s{int(x)}\u00e9": int(10 ** rng.uniform(0, 5)) for x in rng.choice(1000, size=n, replace=False)} | {None: 50}
    hist = spark.createDataFrame([(s, z, 1) for s, z in sizes.items()], "source string, size long, n long")
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    got = {r["source"]: r["target"] for r in mixing.goals(hist, (5, 2, 1), 1.5, 2).collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_shards(spark):
    for docs in (awkward(spark), table(spark, "documents"), table(spark, "documents", "/root/testdata/sf0.01")):
        rows = sharding.kd_shards(docs, 16).collect()
        want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect()]
        same([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], want)
        slots, size, of = defaultdict(list), Counter(), defaultdict(set)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
            of[(r["text_crc32"], r["size"])].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 16
    weight = Counter()
    for r in rows:
        weight[(r["text_crc32"], r["size"])] += r["size"]
    small = {t for t, w in weight.items() if w <= mean * sharding.HOT_SHARE}
    assert len(small) > 900 and all(len(of[t]) == 1 for t in small)  # equal texts stay together
    assert max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    assert sharding.kd_shards(empty(spark), 16).count() == 0


def test_a_group_too_large_for_a_shard_is_split(spark):
    rows = [(i, "same text " * 30, "en", "a", 1) for i in range(3000)] + [(3000 + i, f"text {i} " * (i % 40 + 1), "en", f"s{i % 7}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = [r["s"] for r in sharding.kd_shards(docs, 16).groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
    assert len(size) == 16 and max(size) < 1.05 * min(size)


def brute_leaves(items, dims, shards):
    """(nodes, cuts) of the plain k-d tree: at each node the widest dimension, sorted by level and tie, halved by weight."""
    nodes, total = {1: items}, sum(r["w"] for r in items)
    while len(nodes) < shards:
        below = {}
        for n, rows in nodes.items():
            spread = {d: max((r[d] for r in rows), default=0) - min((r[d] for r in rows), default=0) for d in dims}
            d = max(dims, key=lambda d: (spread[d], -dims.index(d)))
            rows = sorted(rows, key=lambda r: (r[d], r["tie"]))
            half, at, best = sum(r["w"] for r in rows) / 2, 0, 0
            for r in rows:
                if at >= half:
                    break
                at, best = at + r["w"], best + 1
            below[2 * n], below[2 * n + 1] = rows[:best], rows[best:]
        nodes = below
    return nodes, total


def test_leaves_are_those_of_the_plain_tree(spark):
    """Each leaf holds the plain tree's items but for those at a cut, whose weight is below a thousandth of the node's."""
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    _, items, n = sharding.kd_items(docs, 16)
    got = sharding.kd_leaves(items, sharding.DIMS, 16, n).collect()
    want, total = brute_leaves(got, sharding.DIMS, 16)
    of = {r["_t"]: node for node, rows in want.items() for r in rows}
    moved = sum(r["w"] for r in got if of[r["_t"]] != r["_node"])
    assert set(of.values()) == set(range(16, 32)) == {r["_node"] for r in got} and moved < 0.02 * total
    one = {r["tie"]: r for r in got}
    assert len(one) == len(got)  # ties are distinct, so keys are


def test_sources_alike_in_their_first_bytes_are_told_apart(spark):
    rows = [(i, f"text {i} " + "w " * 30, "en", f"https://host{i % 4}.org" if i % 5 else None, 1) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _, items, _ = sharding.kd_items(docs, 4)
    assert items.select("d_source").distinct().count() == 5 and items.where("d_source = 0").count() == 160
    placed = sharding.kd_shards(docs.where("source IS NOT NULL"), 4, keep=("source",))
    assert placed.groupBy("shard").agg({"source": "min"}).toDF("shard", "a").join(placed.groupBy("shard").agg({"source": "max"}).toDF("shard", "z"), "shard").where("a = z").count() >= 2


def test_a_third_of_null_texts(spark):
    rows = [(i, None if i % 3 == 0 else f"text {i} " * (i % 40 + 1), "en", f"s{i % 7}", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.kd_shards(docs, 16).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(got) == 6000 and len(size) == 16 and max(size.values()) < 1.1 * min(size.values())


def test_fixture_has_repeats():
    assert len(awkward_rows()) > len(set(awkward_rows()))
