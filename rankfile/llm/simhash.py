"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, bloom_filters, discard, row_columns, scratch, small_batches, store, texts

BITS = 64
SEED = 42
#: Rows of one signature from which links are found by growing components instead of trying all pairs.
DENSE = 48


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """The `size`-word windows, repeats included; fewer words: the whole sequence; none: nothing."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def lowered_words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters


def hash_shingles(words: list[bytes], size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle; a shingle is a slice of the words joined once."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.fromiter((digest(x, seed) for x in shingles(words, size)), dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view = memoryview(joined)
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), dtype=np.uint64, count=len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, size: int = 4) -> int:
    return majority(hash_shingles(lowered_words(text), size))


def segments_for(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one must differ by one bit at most.

    If each of s segments differed by two bits or more, fingerprints would differ by 2 s: so 2 s > distance.
    """
    s = distance // 2 + 1
    cuts = [BITS * i // s for i in range(s + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def signatures(prints: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """One column for each segment and wildcard: the segment without that bit, tagged with both."""
    out = np.empty((len(prints), sum(w for _, w in segments)), dtype=np.uint64)
    at = 0
    for s, (first, width) in enumerate(segments):
        part = (prints >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for wild in range(width):
            out[:, at] = (part & ~np.uint64(1 << wild)) | np.uint64((at << 40) | (s << 56))
            at += 1
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def links_of_run(ids: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly what all links of the run join: a spanning forest, grown breadth first."""
    left = np.arange(len(ids))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = popcount(prints[left] ^ prints[queue[0]]) <= distance
            hit = left[near]
            a.append(np.full(len(hit), ids[queue[0]]))
            b.append(ids[hit])
            queue = queue[1:] + hit.tolist()
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def links_in_order(keys: np.ndarray, ids: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key. Rows are sorted by key first."""
    order = np.argsort(keys, kind="stable")
    keys, ids, prints = keys[order], ids[order], prints[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    run = np.repeat(sizes, sizes)
    a, b = [], []
    few = run <= DENSE
    for step in range(1, DENSE):
        at = np.flatnonzero(few[:-step] & (run[:-step] > step)) if len(keys) > step else np.zeros(0, dtype=np.int64)
        if not len(at):
            break
        at = at[keys[at] == keys[at + step]]
        at = at[popcount(prints[at] ^ prints[at + step]) <= distance]
        a.append(ids[at])
        b.append(ids[at + step])
    for first, n in zip(starts[sizes > DENSE].tolist(), sizes[sizes > DENSE].tolist()):
        x, y = links_of_run(ids[first : first + n], prints[first : first + n], distance)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest reachable node) for each node of links (a, b: long), by alternating star steps.

    Each step is grouped minima and equality joins; the links are written to the shared folder after each pair of
    steps, by a number of tasks that follows theirs. Steps end when all links form stars: each node either has larger
    neighbours only, or one, smaller.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = store(edges, "links", links.count())
    while True:
        both = pairs.union(pairs.select("v", "u"))
        around = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        state = around.agg(F.sum("n").alias("n"), F.count_if((F.col("low") < F.col("u")) & (F.col("n") > 1)).alias("open")).first()
        if not state["open"]:
            break
        least = around.select("u", F.least("low", "u").alias("m"))
        # large star: larger neighbours are linked to the least one
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, pairs = pairs, store(small.distinct(), "links", state["n"])
        discard(before)
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row of `docs`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, size) for t in texts(batch, "text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between the ids of `distinct` (id: long, fp: long), in which all fingerprints within `distance`
    are connected. Each fingerprint gives a signature for each segment and wildcard; equal signatures meet."""
    segments = segments_for(distance)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            keys = signatures(fps, segments)
            n = keys.shape[1]
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(fps, n).view(np.int64))], names=["key", "id", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last signature may go on in the next batch
            rest = [x[last:] for x in rows]
            yield linked(*(x[:last] for x in rows))
        if rest is not None:
            yield linked(*rest)

    def linked(key: np.ndarray, i: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = links_in_order(key, i, fp.view(np.uint64), distance)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    keys = distinct.select("id", "fp").mapInArrow(explode, "key long, id long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long")


def classes(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and wordless texts have fingerprint zero and link like any other; texts of any length are hashed whole. Copies share a fingerprint and so are one
    node with their smallest doc_id; only distinct fingerprints are indexed. Repeated rows stay rows. A null doc_id is
    no node: its row has the component of its fingerprint's other rows, else null. An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    prints = store(fingerprints(docs, size), "fingerprints")
    n = prints.count()
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct", n)
    raw = store(fingerprint_links(distinct.where(F.col("id").isNotNull()), distance), "raw-links")
    roots = components(raw)
    discard(raw)
    of = distinct.join(roots, distinct.id == roots.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "id").alias("component_id"))
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near-duplicates by similarity: signatures propose, exact Jaccard similarity of shingle sets decides

#: A text's fingerprint for similarity has SEGMENTS segments of PLACES places. A place is the least value of its own
#: permutation of the shingles' hashes, so it is alike in two texts with the probability of their similarity: at 0.8 a
#: segment differs in one place at most with 0.737, and no segment does in 2 of a million pairs.
SEGMENTS, PLACES = 10, 5
#: Most shingles, and texts, of a block of a cell: what one task compares at once.
BLOCK_SHINGLES, BLOCK_TEXTS = 2_000_000, 4096
#: Shingles whose permutations are made at once, and words whose hashes a task keeps.
STEP, KEPT_WORDS = 4096, 1 << 17
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (3, max(64, SEGMENTS * PLACES)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles as 64-bit hashes, mixed from the words' XXH64 (`known` keeps those met before)."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > KEPT_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _ODD[0, k]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_places(shingles: np.ndarray) -> np.ndarray:
    """The least value of each permutation, over all shingles."""
    out = np.full(SEGMENTS * PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), STEP):
        np.minimum(out, (shingles[None, k : k + STEP] * _ODD[1, : len(out), None]).min(axis=1), out=out)
    return out


def place_signatures(places: np.ndarray) -> np.ndarray:
    """For each segment and wildcard place the segment without that place, as one 64-bit key."""
    mixed = (places.reshape(SEGMENTS, PLACES) ^ (places.reshape(SEGMENTS, PLACES) >> np.uint64(31))) * _ODD[2, : SEGMENTS * PLACES].reshape(SEGMENTS, PLACES)
    keys = mixed.sum(axis=1, keepdims=True, dtype=np.uint64) - mixed
    keys ^= keys >> np.uint64(32)
    return (keys * _ODD[0, 8]).ravel()


def alike(common, a, b, similarity: float):
    """Whether sets of sizes a and b that share `common` elements have the Jaccard similarity."""
    return common >= similarity * (a + b - common)


def spanning_links(sets: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], int]:
    """Links that join exactly what all links among `sets` join (a forest, grown breadth first), and its first root.

    Each set that is met is compared with those not met yet. Growth begins at the set whose elements most others have,
    so that in a group of near copies most are met at once.
    """
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    if len(sets) == 2:
        fits = size.min() >= similarity * size.max()
        return ([(0, 1)] if fits and alike(len(np.intersect1d(*sets, assume_unique=True)), *size, similarity) else []), 0
    names, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    of = [codes[b - n : b] for b, n in zip(ends.tolist(), size.tolist())]
    share = np.add.reduceat(counts[codes], ends - size) / size
    left = np.argsort(-share, kind="stable")
    first, mark, links = int(left[0]), np.zeros(len(names), dtype=bool), []
    queue: list[int] = []
    flat = starts = None
    while len(left):
        if not queue:
            queue, left, flat = [int(left[0])], left[1:], None
            continue
        if flat is None:
            flat = np.concatenate([of[i] for i in left.tolist()])
            starts = np.cumsum(size[left]) - size[left]
        i = queue.pop(0)
        mark[of[i]] = True
        hit = alike(np.add.reduceat(mark[flat], starts, dtype=np.int64), size[i], size[left], similarity)
        mark[of[i]] = False
        if hit.any():
            met = left[hit].tolist()
            links += [(i, j) for j in met]
            queue += met
            left, flat = left[~hit], None
    return links, first


def _sets(batch: pa.RecordBatch, size: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    for text in texts(batch, "text"):
        yield shingle_set(lowered_words(text), size, known)


def _in_cells(size: int, similarity: float):
    """mapInArrow over (cell, block, nid, text), sorted: links of each block and, as (cell, null, nid), its first root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        at, ids, sets, rows = None, [], [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 3
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["cell", "a", "b"])

        def close() -> None:
            links, first = spanning_links(sets, similarity) if len(sets) > 1 else ([], 0)
            rows.extend((at[0], ids[i], ids[j]) for i, j in links)
            rows.append((at[0], None, ids[first]))

        for batch in batches:
            for cell, block, nid, own in zip(*(batch.column(k).to_pylist() for k in range(3)), _sets(batch, size, known)):
                if at != (cell, block):
                    if ids:
                        close()
                    at, ids, sets = (cell, block), [], []
                if not ids or ids[-1] != nid:  # a repeated row is one text
                    ids.append(nid)
                    sets.append(own)
            yield out()
        if ids:
            close()
            yield out()

    return run


def _across_blocks(size: int, similarity: float):
    """mapInArrow over (cell, block, held, nid, root, text), sorted: links between the held texts of a block and all
    texts of its cell, which pass by one after another; of links that join the same groups one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        at, ids, sets, roots, joined = None, [], [], [], {}
        order = flat = starts = lengths = None

        def top(r: int) -> int:
            while joined.get(r, r) != r:
                r = joined[r]
            return r

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for cell, block, held, nid, root, own in zip(*(batch.column(k).to_pylist() for k in range(5)), _sets(batch, size, known)):
                if at != (cell, block):
                    at, ids, sets, roots, joined, flat = (cell, block), [], [], [], {}, None
                if held == 0:
                    if not ids or ids[-1] != nid:
                        ids.append(nid)
                        sets.append(own)
                        roots.append(root)
                    continue
                if not ids:
                    continue
                if flat is None:
                    order, codes = np.unique(np.concatenate(sets), return_inverse=True)
                    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                    flat, starts = codes, np.cumsum(lengths) - lengths
                place = np.searchsorted(order, own)
                place = place[(place < len(order)) & (order[np.minimum(place, len(order) - 1)] == own)]
                mark = np.zeros(len(order), dtype=bool)
                mark[place] = True
                for i in np.flatnonzero(alike(np.add.reduceat(mark[flat], starts, dtype=np.int64), len(own), lengths, similarity)).tolist():
                    x, y = top(roots[i]), top(root)
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        a.append(ids[i])
                        b.append(nid)
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _fetched(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (nid and others) with each node's text; texts that no row of it wants are spared the shuffle."""
    keyed = nodes.select(F.col("nid").alias("_n"), F.col("of.doc_id").alias("_doc"), F.col("of.text_hash").alias("_hash"))
    asked = wanted.groupBy("nid").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "nid"])).alias("_at"))
    asked = store(asked.join(keyed, F.col("nid") == F.col("_n")).drop("_n"), "near-asked")
    # the comparison holds for every nid; it tells the planner that a Bloom filter of `asked` may go before the shuffle
    some = asked.where(F.col("nid") >= 0)
    read = docs.select("doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")))
    return read.select("nid", "text", F.explode("_at").alias("_at")).select("nid", "_at.*", "text")


def near_nodes(docs: DataFrame, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """nid, of (doc_id and text_hash of the row of the smallest doc_id), shingles, keys of each distinct sequence of
    lowered words, which two 64-bit hashes tell apart; and (_id, _hash) of the rows that are repeated. nid is a
    number given on writing."""
    small_batches(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text in texts(batch, "text"):
                words = lowered_words(text)
                joined, own = b" ".join(words), shingle_set(words, size, known)
                both = xxhash.xxh3_128_digest(joined)
                keys = place_signatures(least_places(own)).view(np.int64) if len(own) else np.zeros(0, dtype=np.int64)
                for column, value in zip(out, (int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True), len(own), keys)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "text_hash", "h0", "h1", "shingles", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(prints, "doc_id long, text_hash long, h0 long, h1 long, shingles long, keys array<long>")
    rows = store(rows, "near-rows")
    same = rows.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("shingles").alias("shingles"), F.first("keys").alias("keys"))
    nodes = store(same.select(F.monotonically_increasing_id().alias("nid"), "of", "shingles", "keys"), "near-nodes")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return nodes, repeated.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))


def near_links(docs: DataFrame, nodes: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) between nodes, in which all pairs are connected that share a signature and have the similarity.

    A cell is what shares signatures of one least node: texts that share any signature share a cell. A cell's texts
    are dealt to blocks of bounded size; a task compares a block's texts by their whole shingle sets and gives a
    spanning forest, so no pairs are ever written. Of a cell of several blocks first the blocks' roots are compared;
    then the texts outside its largest group, block by block, with all texts of the cell.
    """
    spark = docs.sparkSession
    keys = nodes.select(F.explode("keys").alias("key"), "nid")
    shared = store(keys.groupBy("key").agg(F.min("nid").alias("cell"), F.max("nid").alias("last")).where("cell <> last").drop("last"), "near-shared")
    with bloom_filters(spark):  # most keys are shared with none
        met = store(keys.join(shared.where(F.col("cell") >= 0), "key").select("cell", "nid").distinct(), "near-cells")
    weighed = met.join(nodes.select(F.col("nid").alias("_n"), "shingles"), F.col("nid") == F.col("_n")).drop("_n")
    blocks = F.greatest(F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS))
    large = store(weighed.groupBy("cell").agg(blocks.alias("_blocks")).where("_blocks > 1").withColumnRenamed("cell", "_large"), "near-large")

    def dealt(members: DataFrame) -> DataFrame:
        block = F.coalesce(F.pmod(F.xxhash64("nid", F.lit(SEED)), F.col("_blocks")), F.lit(0))
        return members.join(large, F.col("cell") == F.col("_large"), "left").select("nid", "cell", block.alias("block"))

    def compared(members: DataFrame, name: str) -> DataFrame:
        with bloom_filters(spark):
            read = _fetched(docs, nodes, members).select("cell", "block", "nid", "text")
            return store(read.repartition("cell", "block").sortWithinPartitions("cell", "block", "nid").mapInArrow(_in_cells(size, similarity), "cell long, a long, b long"), name)

    found = compared(dealt(met), "near-links")
    links = found.where("a IS NOT NULL").select("a", "b")
    if large.isEmpty():
        return links
    centres = found.where("a IS NULL").join(large, F.col("cell") == F.col("_large"), "left_semi").select(F.col("b").alias("nid"), "cell", F.lit(0).cast("long").alias("block"))
    links = links.union(compared(centres, "near-links").where("a IS NOT NULL").select("a", "b"))
    # what is outside the largest group of its cell meets all of the cell
    members = met.join(large, F.col("cell") == F.col("_large"), "left_semi").join(components(links).withColumnsRenamed({"node": "_n"}), F.col("nid") == F.col("_n"), "left")
    members = store(members.select("cell", "nid", F.coalesce("root", "nid").alias("root")), "near-members")
    counts = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
    most = counts.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    outside = members.join(most, "cell").where("root <> most").select("cell", "nid", "root")
    outside = outside.join(nodes.select(F.col("nid").alias("_n"), "shingles"), F.col("nid") == F.col("_n")).drop("_n")
    parts = store(outside.groupBy("cell").agg(blocks.cast("int").alias("parts")), "near-parts")
    held = outside.join(parts, "cell").select("nid", "cell", F.pmod(F.xxhash64("nid", F.lit(SEED)), F.col("parts")).alias("block"), F.lit(0).alias("held"), "root")
    passing = members.join(parts, "cell").select("nid", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("block"), F.lit(1).alias("held"), "root")
    with bloom_filters(spark):
        read = _fetched(docs, nodes, held.union(passing)).select("cell", "block", "held", "nid", "root", "text")
        more = read.repartition("cell", "block").sortWithinPartitions("cell", "block", "held", "nid").mapInArrow(_across_blocks(size, similarity), "a long, b long")
        return links.union(store(more, "near-links"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` (all columns) without near-duplicates: of each group the row of the smallest doc_id stays.

    Texts whose sets of `size`-word shingles (of lowered words) have the Jaccard `similarity` are linked, and a group
    is what links connect. One-wildcard signatures of min-wise fingerprints propose, whole texts decide; see
    near_links(). Wordless and null texts are copies of each other; a text of fewer than `size` words is one shingle.
    Texts of any length are compared whole: a very long one is a block of its own. Ties in doc_id go to the smaller
    hash of the text, repeated rows (same doc_id and text) leave one, that of the least hash of the row. An empty
    table gives no rows. Other columns pass through, whatever their names.
    """
    with scratch():
        nodes, repeated = near_nodes(docs, size)
        roots = components(near_links(docs, nodes, size, similarity)).withColumnsRenamed({"node": "_n"})
        grouped = nodes.select("nid", "of").join(roots, F.col("nid") == F.col("_n"), "left").groupBy(F.coalesce("root", "nid").alias("g")).agg(F.min("of").alias("s"))
        stay = store(grouped.select(F.col("s.doc_id").alias("_id"), F.col("s.text_hash").alias("_hash")), "near-stay", keep=True)
        repeated = store(repeated, "near-repeated", keep=True)
    key = F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_hash"))
    out = apart(docs, F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t")).join(stay, key, "left_semi")
    if repeated.isEmpty():
        return out.select(*row_columns(docs))
    first = Window.partitionBy("_d", "_t").orderBy(F.xxhash64("_row"))
    many = out.join(repeated, key, "left_semi").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return out.join(repeated, key, "left_anti").select(*row_columns(docs)).union(many.select(*row_columns(docs)))
