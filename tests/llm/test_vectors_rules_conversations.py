"""Centroid clustering, quality rules and conversation repair."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tests.oracle import DATA, same

from shardwright.llm import clustering, conversation_sql, conversations, queries, rules


# Clustering


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, tuple(int(np.floor(64.0 * x)) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    own = [list(v) for _, v in sorted(kept, key=mark)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(own))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(own)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            own[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else own[j]
    found = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, c in found:
        each[c] += d
    return sorted((repr(i), c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest()) for i, d, c in found)


def clusters_of(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted((repr(r["vec_id"]), *r[1:]) for r in clustering.clustering(frame, **more).collect())


def test_clusters_equal_sql_and_brute_force_on_the_table(spark):
    same(queries.op11_centroid_clustering(spark, DATA), clustering.clustering_sql())


def test_clusters_of_edge_rows(spark):
    rng = np.random.default_rng(1)
    sound = [(i, rng.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]), (105, [0.5] * 63 + [float("nan")]), (106, [0.5] * 63 + [float("-inf")])]
    ties = [(7, sound[7][1]), (7, sound[7][1]), (None, sound[8][1]), (200, [0.0] * 64), (201, [0.0] * 64)]
    rows = sound + bad + ties
    assert clusters_of(spark, rows) == brute_clusters(rows)
    assert clusters_of(spark, sound[:3]) == brute_clusters(sound[:3])  # fewer than centroids
    same_vector = [(i, [1.0, -1.0] * 32) for i in range(20)]
    assert {r[1] for r in clusters_of(spark, same_vector)} == {0}
    assert clusters_of(spark, bad) == []
    huge = clusters_of(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])
    assert len(huge) == 3 and all(r[2] >= 0 for r in huge)
    extra = spark.createDataFrame([(*r, 1, "x") for r in sound], "vec_id long, embedding array<float>, cluster int, distance string")
    assert clustering.clustering(extra).count() == 60


def test_screening_leaves_most_centroids_of_clustered_vectors_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 40, (16, 64))
    vectors = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 3, (4000, 64))).astype(np.int64)
    own = clustering.Centroids(np.floor(centres).astype(np.int64))
    best, far, taken = own.nearest(vectors, clustering.compressed(vectors))
    exact = ((vectors[:, None] - own.whole[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert taken.mean() < 1.5
    low = clustering.bounds(clustering.compressed(vectors), own.small)
    assert (low <= exact).all() and (clustering.bounds(clustering.compressed(vectors, clustering.FINE), own.fine) <= exact).all()


# Rules


def brute_counts(text):
    words, seen, doubles = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    base = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubles, len(hit), base


EDGES = [None, "", " \n\t ", "a", "a b c d e", "a b c d e a b c d e", "x " * 30_000, "é ü\x0bñ z w " * 40, "l1 l1\nl1 l1\n\n\nl1 l1 ", "\n" * 50, "a\r\nb\r\na\r\n", "<p> $1 %2 | #3 & *4", "🙂 🙂🙂 " * 7, "a b c d e f g h i j\n" * 3]


def test_counts_equal_brute_force(spark):
    got = {r["doc_id"]: tuple(r[1:7]) for r in queries.op12_quality_rules(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert got == {r["doc_id"]: brute_counts(r["text"]) for r in docs}
    frame = spark.createDataFrame(list(enumerate(EDGES)) * 2 + [(None, "a b")], "doc_id long, text string").withColumn("kept", pd_lit("x")).withColumn("n_words", pd_lit("y"))
    rows = rules.quality_rules(frame, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert sorted((repr(r[0]), *r[1:7]) for r in rows) == sorted([(repr(i), *brute_counts(t)) for i, t in enumerate(EDGES)] * 2 + [("None", *brute_counts("a b"))])
    assert all(r["kept"] is not r["base_failed"] for r in rows)
    assert rules.quality_rules(frame.where("false"), spark.createDataFrame([(1, 0)], "doc_id long, quality int")).count() == 0


def pd_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_verdicts_are_those_of_the_list_and_right_on_other_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    found, learned = rules.judged(docs, labels.where("doc_id % 2 = 0"))
    from pyspark.sql import functions as F

    rows = found.select("base_failed", "kept", "doc_id", *(F.expr(e).cast("double").alias(f) for f, e in rules.FEATURES.items())).toPandas()
    by_list = learned.labels(rows[list(rules.FEATURES)].to_numpy())
    assert (rows.kept == (~rows.base_failed & (by_list == 1))).all()
    other = rows.merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id")
    other = other[~other.base_failed]
    assert (other.kept == (other.quality == 1)).mean() > 0.95 and other[other.quality == 1].kept.mean() > 0.98


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (3000, len(rules.FEATURES)))
    y = (~((x[:, 2] > 0.8) | ((x[:, 5] <= 0.3) & (x[:, 7] > 0.5)))).astype(int)
    noise = rng.uniform(size=len(y)) < 0.01
    found = rules.learn(x, np.where(noise, 1 - y, y))
    test = rng.uniform(0, 1, (3000, len(rules.FEATURES)))
    want = (~((test[:, 2] > 0.8) | ((test[:, 5] <= 0.3) & (test[:, 7] > 0.5)))).astype(int)
    assert (found.labels(test) == want).mean() > 0.97
    assert len(found.rules) <= 8 and "symbols > 0.8" in found.text()
    for labels in (np.zeros(20, int), np.ones(20, int), np.empty(0, int)):
        only = rules.learn(x[: len(labels)], labels)
        assert only.rules == () and only.default == (1 if not len(labels) else labels[0])
    coin = rules.learn(x, rng.integers(0, 2, len(x)))
    assert len(coin.rules) <= 2, "labels that no statistic tells apart give no rules"


# Conversations


def brute_repair(rows, damage=True):
    """{conv: result} by dynamic programming over turns and states, audits as texts."""
    groups = {}
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        groups.setdefault(conv, [])
        what = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20 if damage else 19
        text, role = blank(text), blank(role)
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        groups[conv] += [(turn is not None, turn or 0, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        best = {0: (0, "", ())}
        blank = duplicate = truncated = 0
        seen = set()

        def inserted(best):
            best = dict(best)
            for _ in range(3):
                for s, (c, a, b) in list(best.items()):
                    for name in ("user", "assistant"):
                        t = step.get((s, name[0]))
                        new = (c + 2, a + "I", (*b, f"{name}:"))
                        if t and (t not in best or new < best[t]):
                            best[t] = new
            return best

        for _, _, role, text in turns:
            empty, again = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            seen.add((role, text))
            cut = not empty and not again and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            blank, duplicate, truncated = blank + empty, duplicate + (again and not empty), truncated + cut
            new = {}
            for s, (c, a, b) in inserted(best).items():
                ways = [(s, (c + 3, a + "D", b))]
                if not empty and not again:
                    ways += [(step.get((s, role[:1])), (c + cut, a + "K", (*b, f"{role}:{text}")))]
                    ways += [(step.get((s, n[0])), (c + 2 + cut, a + "R", (*b, f"{n}:{text}"))) for n in ("user", "assistant")]
                for t, way in ways:
                    if t is not None and (t not in new or way < new[t]):
                        new[t] = way
            best = new
        c, a, b = min(x for s, x in inserted(best).items() if s in (0, 3))
        numbers = [t[1] for t in turns if t[0]]
        pairs = [x[2][:1] + y[2][:1] for x, y in itertools.pairwise(turns)]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, blank, duplicate, truncated, sum(p not in ("su", "ua", "au") for p in pairs), c, a, hashlib.sha256("\n".join(b).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def results(frame):
    return {r[0]: tuple(r[1:]) for r in frame.collect()}


def test_repairs_equal_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(queries.op13_conversation_repair(spark, DATA))
    assert got == brute_repair(rows) and set(queries.queries()) >= {"op11_centroid_clustering", "op12_quality_rules", "op13_conversation_repair"}


def test_repairs_of_edge_rows_and_long_conversations(spark):
    rng = np.random.default_rng(5)
    pick = lambda of: of[rng.integers(len(of))]
    texts = [None, "", " ", "\t\r\n", "Yes.", "No", "Why? ", "é…!", "a:b\nc.", "same.", "x" * 3000]
    roles = ["user", "assistant", "system", None, "tool", "", "User", "a", "u", "s" * 40 + "1", "s" * 40 + "0"]
    rows = [(conv, pick([None, *range(9)]), pick(roles), pick(texts)) for conv in [None, *range(60)] for _ in range(rng.integers(1, 12))]
    rows += [(900, t, pick(["user", "assistant", "system"]), f"{pick(['Yes', 'No'])} {rng.integers(400)}{pick(['.', '', '!'])}") for t in range(2500)]
    rows += [(901, pick([None, 5]), pick(roles), f"t{k}.") for k in range(300)]
    rows += [(902, k % 7, "user", "again and again.") for k in range(400)] + [(903, t, "assistant", f"answer {t}") for t in range(700)]
    rows += [(904, t, "system", f"order {t}.") for t in range(200)] + [(905, None, None, None)] * 5
    want = brute_repair(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = results(conversations.conversation_repair(frame))
    assert got == want
    clash = frame.where("conv_id < 900").toDF("conv", "turn", "role", "text").withColumn("times", frame_lit(0)).withColumn("fault", frame_lit("x"))
    assert len(results(conversations.conversation_repair(clash, "conv"))) == 60
    assert conversations.conversation_repair(frame.where("false")).count() == 0
    small = [r for r in rows if r[0] is None or r[0] < 900 or r[0] == 905]
    same(conversations.conversation_repair(spark.createDataFrame(small, SCHEMA)), conversation_sql.REPAIR_SQL, {"conversations": pd.DataFrame(small, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})})


def frame_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_dropped_conversations_come_out_empty(spark):
    gone = [(i, t) for i in range(400) for t in range(2) if zlib.crc32(f"{i}:{t}".encode()) % 20 == 0]
    got = results(conversations.conversation_repair(spark.createDataFrame([(i, t, "user", "Hi.") for i, t in gone], SCHEMA)))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and set(got) == {i for i, _ in gone}


@pytest.mark.parametrize("width", [1, 5, 40])
def test_passages_of_blocks_join_to_the_whole(width):
    """Costs between states over parts, joined, are those of the undivided sequence."""
    rng = np.random.default_rng(width)
    whole = [bytes(rng.integers(0, 8, 64).astype(np.uint8)) for _ in range(5)]
    for turns, cost in zip(whole, conversations.passages(whole)):
        joined = np.where(np.eye(4, dtype=bool), 0, conversations.FAR)
        for m in conversations.passages([turns[k : k + width] for k in range(0, 64, width)]):
            joined = np.minimum((joined[:, :, None] + m[None]).min(axis=1), conversations.FAR)
        assert (joined == cost).all()
