import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from shardwright.llm import near_copies
from tests.oracle import DATA


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Smallest ids of the groups over Jaccard >= 0.8 of five-word shingles, for (id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        low[find(i)] = min(key, low.get(find(i), key))
    return sorted(low.values())


def test_stage_equals_brute_force_jaccard(spark):
    """The given documents, near-copies with edits around the threshold, chains of edits and short texts."""
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").toPandas().itertuples()]
    at = 10_000
    for n in (5, 8, 14, 40, 200):
        for edits in (0, 1, 2, 3, 4, 8):
            words = [f"w{rng.randrange(500)}" for _ in range(n)]
            for _ in range(4):
                rows.append((at, " ".join(words)))
                at += 1
                for _ in range(edits):
                    words[rng.randrange(n)] = f"e{rng.randrange(500)}"
    rows += [(at, "one two"), (at + 1, "One  two"), (at + 2, "two one"), (at + 3, None), (at + 4, " "), (at + 5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, DATA).select("doc_id").collect())
    assert kept == brute_kept(rows)
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), DATA).count() == 0


def test_marks_leave_no_pair_at_the_threshold_out():
    """Sets that differ in as many items as similar ones may, in one list, by the kernel alone."""
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for n in range(60):
        base = rng.integers(-(1 << 62), 1 << 62, 145)
        other = np.concatenate([base[15:], rng.integers(-(1 << 62), 1 << 62, 16)])  # 130 of 161 items
        for items in (np.unique(base), np.unique(other)):
            odd = np.bincount((items.view(np.uint64) >> np.uint64(32)) % np.uint64(near_copies.MARKS), minlength=near_copies.MARKS) & 1
            rows.append((len(items), len(rows), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
        want.add((len(rows) - 2, len(rows) - 1))
    rows.sort()
    size, fp, marks = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array(size, pa.int32()), pa.array(fp), pa.array(fp), pa.array(marks, pa.list_(pa.int64())), pa.array([-1] * len(rows), pa.int32())], names=["key", "size", "fp", "root", "marks", "side"])
    got = {p for b in near_copies._close(0.8)(iter([batch])) for p in zip(*b.to_pydict().values())}
    assert want <= got


def test_long_lists_are_dealt_in_parts(spark):
    """Many sets of one list: parts of eight, salts from ten rows on, against brute force; blocks hold every pair that may be similar."""
    rng = random.Random(4)
    common = " ".join(f"c{k}" for k in range(12))
    rows = []
    for at in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 2, 3, 5]))]
        rows.append((at, f"{common} {' '.join(base)}".strip()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_copies(docs, part=8, salted=10).collect()
    assert sorted({r["component_id"] for r in got}) == brute_kept(rows) and len(got) == len(rows)

    sizes = [rng.choice([3, 4, 5, 20, 25, 26, 31, 32, 40]) for _ in range(200)]
    lists = spark.createDataFrame([(7, s, at) for at, s in enumerate(sizes)] + [(8, 5, 1000), (8, 5, 1001)], "key long, size int, fp long")
    met = near_copies.blocks(lists, 0.8, 8).collect()
    held = {}
    for r in met:
        held.setdefault(r["key"], []).append((r["fp"], r["side"]))
    pairs = [(min(a, b), max(a, b)) for rows in held.values() for a, p in rows for b, q in rows if a < b and (p < 0 or p != q)]
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b])} | {(1000, 1001)}
    assert want <= set(pairs) and len(pairs) == len(set(pairs))
    assert max(len(v) for v in held.values()) < 60


def test_components_of_long_chains(spark):
    """Chains over many partitions, cycles, repeated edges and loops."""
    from shardwright.llm.components import components

    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 400) if k % 100 != 99] + [(1000, 1001), (1001, 1000), (1001, 1002), (1002, 1000), (5000, 5000)]
    names = list(range(6000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in edges] * 2
    rng.shuffle(edges)
    groups = [range(0, 100), range(100, 200), range(200, 300), range(300, 400), range(1000, 1003)]
    want = {names[k]: min(names[i] for i in g) for g in groups for k in g}
    for part in (1 << 17, 40):  # one partition, and rounds
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(9), part=part).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_wide_marks_leave_similar_pairs_only(spark):
    """Large sets that share a few items don't get as far as an item by item check; those at the threshold do, at unequal lengths of marks too."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(-(1 << 62), 1 << 62, n)
    base, long = fresh(1000), fresh(1030)  # 2048 and 4096 places
    cases = [(base, np.concatenate([base[:20], fresh(980)]), False), (base, np.concatenate([base[:889], fresh(111)]), True), (long, long[:1000], True), (long, np.concatenate([long[:500], fresh(500)]), False)]
    sets = [tuple(np.unique(x) for x in pair[:2]) for pair in cases]
    rows = [[at, at + 100, at, at + 100, len(a), len(b), near_copies.wide_marks(a), near_copies.wide_marks(b)] for at, (a, b) in enumerate(sets)]
    names = ["a", "b", "id_a", "id_b", "size_a", "size_b", "wide_a", "wide_b"]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n[:4] == "wide" else pa.int64()) for n, c in zip(names, zip(*rows))], names=names)
    got = {a for b in near_copies._wide_near(0.8)(iter([batch])) for a in b.column(0).to_pylist()}
    assert got == {at for at, pair in enumerate(cases) if pair[2]}
    assert near_copies.wide_marks(fresh(200)) is None


def test_picked_rows_by_blocks(spark):
    from shardwright.llm.simhash import picked

    keys = [0, 1, 62, 63, 64, 127, 128, (1 << 33) + 63, (1 << 33) + 64, (5 << 33) + 7]
    rows = spark.createDataFrame([(k, f"t{k}") for k in keys], "_row long, text string")
    for want in ([], keys, [63, 64, (1 << 33) + 63], [0, (5 << 33) + 7]):
        for most in (1 << 20, 1):
            got = picked(rows, spark.createDataFrame([(k,) for k in want], "_row long"), most)
            assert sorted(map(tuple, got.collect())) == [(k, f"t{k}") for k in want] and got.columns == ["_row", "text"]
