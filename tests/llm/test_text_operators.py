import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from shardwright.llm import contamination_sql, decontam, langid, licenses, lm, mixing, quality, simhash
from tests.oracle import DATA, same

EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", "en", None), (4, "!!! 123 $$$", None, "b"), (5, "word " * 60_000, "en", "a"), (6, "same text here again", "en", "a"), (6, "same text here again", "en", "a"), (7, "same text here again", "en", "b"), (None, "no id at all here", "de", "b"), (8, "ünï çödé ßtraße", "de", None)]


def edge_docs(spark, more=()):
    docs = spark.createDataFrame([*EDGE, *more], "doc_id long, text string, lang string, source string")
    # Columns that operators might want for themselves.
    clash = {c: F.lit(f"x{c}") for c in ("_n", "_kept", "_lang", "_score", "_spans", "_n_words", "_hit_ranges", "_hit_items", "fp", "id", "t", "_text", "_id", "n_tokens", "weight", "epoch", "block", "key", "row", "score", "n", "_y", "blocks")}
    return docs.withColumns(clash)


def empty(spark):
    return edge_docs(spark).where("false")


def docs_of(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- near-duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs):
    """{row: smallest id reachable} for (id, fp)."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j in range(i):
            if (a ^ pairs[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            low[find(i)] = min(key, low.get(find(i), key))
    return [low.get(find(i)) for i in range(len(pairs))]


def test_simhash_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in docs_of(spark).toPandas().itertuples()]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    got = simhash.simhash_components(docs_of(spark)).toPandas().sort_values("doc_id")
    want = pd.DataFrame({"doc_id": [i for i, _ in fps], "fp": [f"{f:016x}" for _, f in fps], "c": brute_components(fps)}).sort_values("doc_id")
    assert got.fingerprint.tolist() == want.fp.tolist() and got.component_id.tolist() == want.c.tolist()
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs_of(spark)).select("doc_id").collect())
    assert kept == sorted(set(want.c))


def test_simhash_edge_rows(spark):
    rows = simhash.simhash_components(edge_docs(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert len(rows) == len(EDGE) and by[1] == by[2] == by[3] == [("0" * 16, 1)] and len(by[6]) == 2 and by[7][0][1] == 6
    assert {f"{brute_fingerprint(t):016x}" for i, t, *_ in EDGE if i == 5} == {by[5][0][0]}
    kept = simhash.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns and [r["doc_id"] for r in kept.where("doc_id in (6, 7)").collect()] == [6]
    assert simhash.simhash_components(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("cap", [3, 16384])
def test_links_lose_nothing_in_full_buckets(spark, cap):
    """Chains and clusters of fingerprints, with buckets far beyond a small cap."""
    rng, fps = random.Random(4), set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from shardwright.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), cap)).collect()}
    groups = {}
    for s, c in zip(signed, brute_components(list(enumerate(fps)))):
        groups.setdefault(c, set()).add(s)
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(s, s) for s in signed}) == len(groups)


# --- decontamination


def test_contamination_equals_sql(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    same(decontam.contamination(docs_of(spark), bench), contamination_sql.CONTAMINATION_SQL)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_contamination_of_short_overlapping_and_null_items(spark, block):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, " ".join(f"w{k}" for k in range(14))), (3, None), (4, "..."), (5, "zz"), (1, "gamma"), (None, "omega")], "item_id long, text string")
    long_hit = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, "ALPHA, Beta! x"), (2, f"pre {long_hit} post"), (3, None), (4, "alpha x beta zz zz gamma omega"), (5, " ".join(["q"] * 30 + ["zz"]))], "doc_id long, text string").withColumn("_n_words", F.lit("mine"))
    found = decontam.find_contamination(docs, bench, max_block_bytes=block).collect()
    got = {r["doc_id"]: ([tuple(x) for x in r["_hit_ranges"]], r["_hit_items"]) for r in found}
    assert got == {1: ([(0, 2)], [1]), 2: ([(1, 15)], [2]), 3: ([], []), 4: ([(3, 7)], [1, 5]), 5: ([(30, 31)], [5])}
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5] and kept.first()["_n_words"] == "mine"
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(edge_docs(spark), bench.where("false")).where("contaminated or n_hit > 0").count() == 0


def test_wu_manber_against_plain_search(monkeypatch):
    monkeypatch.setattr(decontam, "LANE", 3)
    rng = random.Random(3)
    for _ in range(200):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))).encode()) for k in range(rng.randint(1, 6))]
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).encode() for _ in range(3)]
        counts, ranges, found = decontam.Index(items, 4).hits(texts)
        for text, n, r, got in zip(texts, counts, ranges, found):
            words, hit, held = text.split(), set(), set()
            for k, item in items:
                ws = item.split()
                for at in range(max(1, len(ws) - 3) if ws else 0):
                    pattern = ws[at : at + 4]
                    for i in range(len(words) - len(pattern) + 1):
                        if words[i : i + len(pattern)] == pattern:
                            hit.update(range(i, i + len(pattern)))
                            held.add(k)
            assert n == len(words) and {w for lo, hi in r for w in range(lo, hi)} == hit and got == held


def test_equal_hashes_do_not_match(monkeypatch):
    """Direct comparison confirms: with all words hashed alike, only the same words are hits."""
    plain = decontam.word_hashes
    monkeypatch.setattr(decontam, "word_hashes", lambda texts: (*(r := plain(texts))[:3], np.zeros_like(r[3]), r[4]))
    _, ranges, _ = decontam.Index([(1, b"one two three")], 13).hits([b"x one two three y", b"a b c d e"])
    assert ranges == [[(1, 4)], []]


def test_a_large_benchmark_is_one_compact_index():
    rng = random.Random(1)
    vocabulary = [f"word{k}" for k in range(50_000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=1000)).encode()) for k in range(1000)]
    index = decontam.Index(items)
    size = len(index.text) + sum(a.nbytes for held in (index, *index.patterns) for a in vars(held).values() if isinstance(a, np.ndarray))
    assert size < 12 * sum(len(t) for _, t in items)
    inner = b" ".join(items[700][1].split()[40:60])
    counts, ranges, found = index.hits([b"before " + inner + b" after"])
    assert counts.tolist() == [22] and ranges == [[(1, 21)]] and found == [{700}]


# --- licences and mixing


def test_license_scan_equals_sql(spark):
    same(licenses.license_scan(docs_of(spark)).drop("blocks"), licenses.license_sql())


def test_license_scan_of_odd_texts_equals_sql(spark):
    notice = licenses.TEMPLATES["mit-notice"]
    texts = [None, "", "mit license mit license", "The MIT-License. cc by cc by cc", f"x\n{notice}\n\ny", " ".join(notice.split()[:15]), "Gnu GENERAL public LICENSE apache license", "K MIT LICENSE worK", "apache\nlicense", "mit  license" * 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string").withColumn("blocks", F.lit(1))
    view = docs.select("doc_id", "text").toPandas()
    same(licenses.license_scan(docs).drop("blocks"), licenses.license_sql(), {"documents": view})
    assert licenses.license_scan(empty(spark)).count() == 0
    hit = licenses.license_scan(docs).where("doc_id = 4").first()
    assert hit["blocks"][0]["word"] == 0 and hit["blocks"][0]["label"] == "mit-notice" and hit["score"] == 1.0


def test_notices_wrapped_over_lines_and_deep_in_a_text(spark):
    mit, bsd = licenses.TEMPLATES["mit-notice"].split(), licenses.TEMPLATES["bsd-notice"].split()
    far = " ".join(f"w{k}" for k in range(777))
    texts = [" ".join(mit[:13]) + "\n * " + " ".join(mit[13:]), f"{far}\n" + "\n".join(mit) + f"\n{far}", f"{far} {' '.join(bsd[:9])}\n\n{' '.join(bsd[9:])}", " ".join(w for k, w in enumerate(mit) if k % 2), far]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(docs).collect()}
    assert got == {0: ("mit-notice", 1.0), 1: ("mit-notice", 1.0), 2: ("bsd-notice", 1.0), 3: ("", 0.0), 4: ("", 0.0)}
    same(licenses.license_scan(docs).drop("blocks"), licenses.license_sql(), {"documents": docs.toPandas()})


@pytest.mark.parametrize("rows", [0, 20_000])
def test_many_templates_join_alike(spark, monkeypatch, rows):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(300)]
    templates = {f"t{k}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 15))) for k in range(200)}
    texts = [" ".join(rng.choices(vocabulary, k=30) + [w for w in templates[f"t{k}"].split() if rng.random() < 0.85] + rng.choices(vocabulary, k=20)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(licenses.license_scan(docs, templates=templates).drop("blocks"), licenses.license_sql(templates=templates), {"documents": docs.toPandas()})


@pytest.mark.parametrize("entropy,limit", [(0.5, 4.0), (0.999, 4.0), (1.0, 1.3), (1.0, 0.5)])
def test_mix_equals_sql(spark, entropy, limit):
    skewed = docs_of(spark).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    view = skewed.toPandas()
    same(mixing.mix(skewed, entropy=entropy, max_epochs=limit, block_docs=8), mixing.mixing_sql(entropy=entropy, max_epochs=limit, block_docs=8), {"documents": view})


def test_mix_keeps_to_budgets_and_handles_odd_rows(spark):
    got = mixing.mix(edge_docs(spark), block_docs=2)
    assert got.count() > 0 and got.where("source is null").count() == 0
    used = docs_of(spark).select("doc_id")
    out = mixing.mix(docs_of(spark), entropy=1.0, max_epochs=1.5).toPandas()
    total = sum(len(t.split()) for t in docs_of(spark).toPandas().text)
    assert out.n_tokens.sum() <= total and out.groupby(["doc_id", "epoch"]).size().max() == 1
    assert (out.groupby("source").n_tokens.sum() <= out.groupby("source").weight.first() * total + 1).all()
    assert set(out.doc_id) <= {r[0] for r in used.collect()}
    assert mixing.mix(empty(spark)).count() == 0


def test_rows_without_ids_spread_over_blocks(spark):
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(docs).where("epoch = 1")
    sizes = [r["n"] for r in out.groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 40 and max(sizes) < 2 * mixing.BLOCK_DOCS
    same(mixing.mix(docs.limit(500)), mixing.mixing_sql(), {"documents": docs.limit(500).toPandas().astype({"doc_id": "Int64"})})


# --- language, quality, language model


def test_language_of_held_out_and_mixed_texts(spark):
    got = langid.language_id(docs_of(spark)).toPandas().merge(docs_of(spark).toPandas()[["doc_id", "lang"]], on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id])
    assert (got.held_out == held).all() and (got.lang_pred == got.lang)[held].mean() >= 0.97
    model = langid.train(docs_of(spark))
    texts = docs_of(spark).toPandas().set_index("lang").text
    english, french = (" ".join(langid.words_of(texts[n].iloc[0])[:80]) for n in ("en", "fr"))
    (language, score, spans), = langid.Labeller(model).label([f"{english} {french}"])
    assert {s[2] for s in spans} == {"en", "fr"} and len(spans) <= 4 and 0 < score < 1


def test_language_edge_rows(spark):
    got = langid.language_id(edge_docs(spark, [(20, "Привет мир", None, "a"), (21, "der die das und", "de", "b"), (22, "the and of is", "en", "b")])).toPandas().set_index("doc_id")
    assert (got.loc[[1, 2, 3, 4]].lang_pred == "und").all() and (got.score.between(0, 1)).all() and got.loc[20].lang_pred in ("de", "en")
    assert langid.language_id(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_figures_are_no_letters_and_marks_belong_to_words(spark):
    assert langid.words_of("² ½ ① Ⅷ 3 _") == [] and langid.words_of("हिन्दी été") == ["हिन्दी", "été"]
    more = [(30, "² ½ 3", None, "a"), (31, "①", None, "a"), (32, "the and of", "en", "a"), (33, "der die das", "de", "a"), (34, "the and of", "en", "a")]
    got = langid.language_id(edge_docs(spark, more)).where("doc_id in (30, 31)").collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2


def test_all_languages_are_learned(spark):
    """300 languages, each of words of its own; also those of a single document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    own = {f"l{k:03d}": [word() for _ in range(12)] for k in range(300)}
    docs = [(k, " ".join(rng.choices(ws, k=40)), lang) for k, (lang, ws) in enumerate(own.items())]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == sorted(own)
    found = langid.Labeller(model).label([" ".join(rng.choices(ws, k=30)) for ws in own.values()])
    assert sum(f[0] == lang for f, lang in zip(found, own)) >= 295


def test_labelling_and_training_hold_few_bytes_a_word(spark, monkeypatch):
    """Words of a text go before the next one's are made; words of training are folded in by parts."""
    import tracemalloc

    model = langid.model_from_counts([(n, [(-1, None, 1), (-2, "Latin", 9), (k, None, 3)]) for k, n in enumerate(("de", "en"))])
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + j % 26)}" for j in range(2000)) for k in range(200)]
    labeller = langid.Labeller(model)
    labeller.label(texts[:1])
    tracemalloc.start()
    found = labeller.label(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 200 and peak < 90 * 400_000, peak / 400_000
    parts, whole = [], langid.grams

    def noted(words):
        parts.append(len(words))
        return whole(words)

    monkeypatch.setattr(langid, "grams", noted)
    rows = [("en", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000)))]
    langid.folded({"en": Counter(langid.words_of(rows[0][1]))}, {}, Counter())
    assert len(parts) == 3 and max(parts) <= langid.FOLD_WORDS and sum(parts) == 17_000


def test_scripts_narrow_candidates():
    model = langid.model_from_counts([("en", [(-1, None, 2), (-2, "Latin", 100), (7, None, 3)]), ("ru", [(-1, None, 1), (-2, "Cyrillic", 100), (5, None, 3)])])
    scores = model.scores_of(["привет", "hello", "שלום"])
    assert scores[0].argmax() == 1 and scores[0][0] == -12 and scores[1].argmax() == 0 and scores[1][1] == -12 and (scores[2] == 0).all()


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(0, 5, 4)
        scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32)
        path, at = langid.viterbi(scores, lengths, 0.8), 0
        cost = lambda p, s: sum(s[i][x] for i, x in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))
        for n in lengths:
            own = scores[at : at + n]
            assert cost(path[at : at + n], own) == pytest.approx(max(cost(p, own) for p in product(range(3), repeat=int(n))), abs=1e-4)
            at += n


def test_quality_of_held_out_rows():
    sf = DATA.replace("sf0.001", "sf0.01")
    rows = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id])
    net = quality.fit([t.encode() for t in rows.text[~held]], rows.quality[~held].to_numpy())
    p = net.scores([t.encode() for t in rows.text[held]])
    y = rows.quality[held].to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert auc >= 0.9 and ((p >= 0.5) == y).mean() >= 0.9


def brute_logit(net, text):
    """The network by plain loops over one text."""
    data = text.ljust(quality.HALF * ((len(text) + quality.HALF) // quality.HALF), b" ")
    n, places = len(data), quality.HALF // quality.STRIDE
    padded = data + b" " * quality.WIDTH
    z = np.array([np.concatenate([net.embed[b] for b in padded[k : k + quality.WIDTH]]) @ net.conv for k in range(0, n, quality.STRIDE)])
    z[-1] = -np.inf
    halves = [np.maximum(z[k : k + places].max(axis=0) + net.bias, 0) for k in range(0, len(z), places)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    f = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
    return float((f - net.mean) / net.scale @ net.out + net.rate[0])


def test_query_scores_equal_a_plain_network(spark, monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    kept = {}
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, y, *a: kept.setdefault("net", fit(texts, y, 1)))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = docs_of(spark).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    for r in docs.collect():
        if len(r["text"] or "") > 4000:
            continue
        want = 1 / (1 + math.exp(-brute_logit(kept["net"], (r["text"] or "").encode())))
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.5)


def test_long_labelled_texts_train(spark, monkeypatch):
    """Texts of 200 KB, told apart only at their end; and the sample stops at its bytes."""
    seen = {}
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda texts, y, *a: seen.setdefault("net", (texts, y) and fit(texts, y, 2)) if not seen.update(n=[len(t) for t in texts]) else None)
    rows = [(k, "ab " * 66_000 + ("good words " if k % 2 else "#### @@@@ ") * 400) for k in range(30)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert min(seen["n"]) > 198_000 and all(r["predicted"] == r["doc_id"] % 2 for r in got)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1_000_000)
    quality.train(docs, labels)
    assert len(seen["n"]) == 5


def test_network_gradient():
    rng = np.random.default_rng(2)
    texts, labels = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (10, 700, 1500, 300)], np.array([0, 1, 1, 0], np.float32)
    net = quality.fit([b"a" * 300, b"b" * 300], np.array([0, 1]), epochs=1)
    for p in net.parameters():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    grads, _ = net.gradients(texts, labels)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        up = net.gradients(texts, labels)[1]
        p[at] = old - step
        down = net.gradients(texts, labels)[1]
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.15, abs=2e-3)


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, None), (7, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    for l in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.quality(edge_docs(spark), l).toPandas()
        assert len(got) == len(EDGE) and got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert quality.quality(empty(spark), labels).count() == 0


def test_common_words_cost_no_more_in_a_large_benchmark():
    """Words by Zipf's law: a place meets only patterns with all its words, so finds don't grow with the benchmark."""
    rng = np.random.default_rng(1)
    text = lambda n: b" ".join(b"w%d" % k for k in rng.zipf(1.15, n) % 50_000)
    docs = [text(800) for _ in range(40)]
    items = [(k, text(400)) for k in range(1500)]
    items += [(10_000 + k, b" ".join(docs[5].split()[100:140])) for k in range(300)]  # one passage in many items
    index = decontam.Index(items)
    _, ranges, found = index.hits(docs)
    assert ranges[5] == [(100, 140)] and found[5] == set(range(1500, 1800)) and not any(r for k, r in enumerate(ranges) if k != 5)
    hashes = decontam.word_hashes(docs)
    begins = np.cumsum(hashes[4]) - hashes[4]
    places, rows = index.patterns[0].search(hashes[3], begins, begins + hashes[4])
    assert len(places) == 28 and len(set(rows.tolist())) == 28


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in rows}
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens) if not held[i] for w in ws)
    n = sum(c.values())
    d = n + 0.1 * (len(c) + 1)
    return sorted(((i is None, i or 0), held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / d) for w in ws), 6)) for (i, _), ws in zip(rows, tokens))


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_base_score_equals_brute_force(spark, head):
    for docs in (docs_of(spark), edge_docs(spark)):
        got = lm.lm_scores(docs, head=head).collect()
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
        assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert lm.lm_scores(empty(spark)).count() == 0


def test_filter_holds_counts_and_rarely_errs(spark):
    rng = np.random.default_rng(0)
    keys, n = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(1, 500, 20_000)
    levels = lm.LogFrequencyFilter.level_of(n)
    codes = lm.PARTS + np.floor(lm.PARTS * np.log2(n)).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"kind": np.repeat([1, 3], 20_000), "key": np.concatenate([keys, keys ^ np.uint64(1 << 62)]).view(np.int64), "level": np.concatenate([levels, codes])}))
    table, slice_bits, slices, probes = lm.build_filter(rows, int(levels.sum() + (codes // lm.PARTS + 1).sum()), 20_000)
    bits = b"".join(r["bits"] for r in table.orderBy("slice").collect())
    f = lm.LogFrequencyFilter(np.frombuffer(bits, np.uint8), slice_bits, slices, probes)
    assert (f.levels(keys) >= levels).all() and (f.levels(keys) > levels).mean() < 0.001
    assert (f.totals(keys ^ np.uint64(1 << 62)) == codes).mean() > 0.999
    assert (f.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.001


def brute_scores(rows, mistaken):
    """The model by exact counts: {id: score}; words as bytes, None ends a text, 0 begins it."""
    tokens = {i: [0, *(t or "").encode().lower().split(), None] for i, t in rows}
    known = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    words, pairs = Counter(x for w in known for x in w[1:]), Counter(p for w in known for p in zip(w, w[1:]))
    level = lambda n: int(math.log2(n)) + 1 if n else 0
    means = []
    for table in (words, pairs):
        by = {}
        for n in table.values():
            by.setdefault(level(n), []).append(n)
        means.append({0: 0.0, **{q: sum(ns) / len(ns) for q, ns in by.items()}})
    total = Counter()
    for (h, _), n in pairs.items():
        total[h] += means[1][level(n)]
    parts = {h: math.ceil(lm.PARTS * math.log2(t) - 1e-9) for h, t in total.items()}
    read, top = {h: 2 ** (e / lm.PARTS) for h, e in parts.items()}, {h: e // lm.PARTS + 1 for h, e in parts.items()}
    n, v = sum(words.values()), len(words)

    def log(h, w):
        q = min(level(pairs[h, w]), level(words[w]), top.get(h, 0))
        return math.log10((means[1][q] + lm.PRIOR * (means[0][level(words[w])] + 0.1) / (n + 0.1 * (v + 1))) / (read.get(h, 0.0) + mistaken + lm.PRIOR))

    return {i: sum(map(log, w, w[1:])) for i, w in tokens.items()}


def test_score_equals_exact_counts_by_broadcast_and_by_slices(spark, monkeypatch):
    """With probes enough the filter reads no pair by mistake; in a crowded one some are."""
    monkeypatch.setattr(lm, "STRETCH", 100)
    rows = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()} | {-1: None, -2: "", -3: "word " * 5000}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for probes, bits in ((None, lm.MAX_BITS), (None, 1), (8, lm.MAX_BITS), (8, 1)):
        if probes:
            monkeypatch.setattr(lm, "probes_for", lambda _: 8)
        want = brute_scores(rows.items(), lm.train(docs.where(~lm.held_out()))[0].mistaken)
        got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, max_bits=bits).collect()}
        assert got.keys() == want.keys()
        if not probes:
            near = [abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want]
            assert sum(near) >= 0.95 * len(near), "a few texts hold a pair read by mistake"
        assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.01


def test_probabilities_sum_to_one(spark):
    model, words, _ = lm.train(docs_of(spark))
    vocabulary = words.orderBy(F.desc("n"), "key").toPandas().key.to_numpy().view(np.uint64)
    of_word = model.filter.levels(vocabulary)
    for first in [*vocabulary[:60], *vocabulary[-20:], np.uint64(lm.START), np.uint64(12345)]:
        pairs = lm.pair_keys(np.full(len(vocabulary), first), vocabulary)
        total = np.full(len(vocabulary), model.filter.totals(lm.total_keys(pairs[:1]))[0])
        unknown = model.logs(np.zeros(1, int), np.zeros(1, int), total[:1])
        assert abs((10 ** np.concatenate([model.logs(of_word, model.filter.levels(pairs), total), unknown])).sum() - 1) < 0.05


def test_no_probability_passes_one(spark):
    """Also where nearly all of a word's pairs are one pair, whatever its count."""
    for n in (2, 3, 7, 60, 1001, 60_001):
        rows = [(1, "same " * n), (2, "same other"), (3, "other same")]
        model, words, _ = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
        tokens, lengths = lm.Hasher().tokens([t.encode() for _, t in rows] + [b"", b"unseen same"])
        assert (model.token_logs(tokens, lengths) <= 1e-12).all()


@pytest.mark.parametrize("words", [24_000, 5_000_000, 100_000_000, 10_000_000_000])
def test_absent_pairs_weigh_little_at_any_size(words):
    """Pairs read by mistake after one word: the vocabulary's share that half-full slices let through."""
    assert words * 0.5 ** lm.probes_for(words) < 0.1


def test_a_crowded_filter_still_tells_pairs_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5000)) for k in range(300)]
    model, _, _ = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.mistaken < 0.1
    tokens, lengths = lm.Hasher().tokens([t.encode() for _, t in rows[:50]])
    seen = lm.pair_keys(lm.before(tokens, lengths), tokens)
    assert (model.filter.levels(seen) > 0).all()
    assert (model.filter.levels(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)) > 0).sum() < 20


def test_repeated_passages_score_higher_than_the_base(spark):
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(i, f"{text} {i}") for i in range(1, 60)] + [(100 + i, f"w{i} v{i} u{i}") for i in range(60)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out and doc_id < 100").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_slices_take_less_disk_than_the_texts_and_give_exact_base_scores(spark, monkeypatch):
    """Keys go to the filter packed, once for a block; all that is written stays below twice the text (limit of the check: 4 times its packed size)."""
    written = []
    stored = lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, label: written.append(stored(df, label)) or written[-1])
    docs = docs_of(spark).unionByName(edge_docs(spark).select("doc_id", "text"), allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = lm.lm_scores(docs, max_bits=1).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    files = {f for df in written for f in df.inputFiles()}
    assert sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in files) < 2 * sum(len((t or "").encode()) for _, t in rows)
