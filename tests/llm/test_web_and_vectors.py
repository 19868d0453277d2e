import gzip
import hashlib
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardwright.llm import ann, html_extract, warc
from tests.oracle import DATA, same


def pages_of(spark):
    return spark.read.parquet(f"{DATA}/pages.parquet")


# --- archives


def test_archives_equal_sql(spark):
    same(warc.archive_round_trip(pages_of(spark)), warc.WARC_SQL)


def test_archives_of_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 3)
    big, binary = "é" * 600, "line\r\n\r\nWARC/1.1\r\n\0\x01 end" * 60
    rows = [(1, "http://a.com/x", big), (9, "http://www.a.com/x", big), (5, "http://A.com:80/x#f", big), (5, "http://a.com/x", big), (2, "http://b.com", "short"), (3, "http://b.com", "short"), (4, None, None), (None, "http://z.org/\r\nbad: 1", big), (6, "no url", binary), (7, "http://b.com/?q", binary), (8, "http://b.com/?q", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "keep", "n", "value")}).repartition(4)
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        i, _, html = next(x for x in rows if x[0] == r["page_id"])
        data = (html or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        same_ = [x[0] for x in rows if x[2] == html and x[0] is not None]
        keep = max(same_) if len(data) >= 1000 and same_ else None
        assert (r["record_type"], r["refers_to"]) == (("revisit", keep) if keep is not None and i != keep else ("response", None))
    ordered = sorted(got, key=lambda r: r["capture_rank"])
    assert [r["capture_rank"] for r in ordered] == list(range(len(rows))) and [r["url_key"] for r in ordered] == sorted(r["url_key"] for r in got)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def archives(folder):
    return sorted(folder.glob("part-*"))


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages_of(spark).limit(5), str(tmp_path / "w"))
    records = [e for f in archives(tmp_path / "w") for e in warc.read_archive(f.read_bytes(), f.name)]
    assert len(records) == 5
    content = max(archives(tmp_path / "w"), key=lambda f: f.stat().st_size).read_bytes()
    assert gzip.decompress(content).count(b"WARC/1.1\r\n") == len(list(warc.read_archive(content, "x")))
    data = gzip.decompress(content[: warc.read_record(content, 0)[2]])
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError, match="wrong payload"):
        list(warc.read_archive(gzip.compress(data.replace(b"<p>", b"<q>", 1)), "x"))
    with pytest.raises(ValueError, match="torn record"):
        list(warc.read_archive(gzip.compress(data)[:-9], "x"))


def test_archives_are_bounded_by_bytes_and_read_by_offset(spark, tmp_path, monkeypatch):
    """Workers take the module's own bounds, so pages are large: 12 of 3 MB that do not compress, and one beyond a member."""
    rng = random.Random(4)
    noise = lambda n: rng.randbytes(n).hex()
    rows = [(k, f"http://a.com/{k}", noise(1_500_000)) for k in range(12)] + [(12, "http://a.com/12", noise(10 << 20)), (13, "http://a.com/13", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    found = archives(tmp_path / "w")
    assert len(found) > 1 and max(f.stat().st_size for f in found) < warc.ARCHIVE_CHUNKS * warc.CHUNK_BYTES + (22 << 20)
    n = 0
    for f in found:
        content = f.read_bytes()
        for entry in list(warc.read_archive(content, f.name)):
            again, payload, _ = warc.read_record(content, entry[-1], f.name)
            assert again == entry and payload.decode() == rows[entry[2]][2]
            n += 1
    assert n == len(rows)


def test_repeated_payloads_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    same(warc.archive_round_trip(pages_of(spark)), warc.WARC_SQL)


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 7))]
        assert [x for _, x in warc.LoserTree([iter(r) for r in runs])] == sorted(sum(runs, []))


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav><!-- <p>no</p> --><div class="cookie-notice">Cookies</div><div class="ad">Buy</div>
<article class="post"><header><h1>Title &amp; more</h1><p>By someone</p></header><p>One  two<br>three &#8364;&nbsp;x</p><p>Open<div>Div <b>bold</b>text</div><form><p>Mail</p></form>
<aside>Side</aside><div style="display:none">hidden</div><ul><li>a</li><li>b</li></ul>tail<section id="comments"><p>First!</p></section></article>
<div class="sidebar">Links</div><footer>&copy; me</footer></body></html>"""


def text_of(html):
    return "\n".join(t for t, k in html_extract.blocks(html) if k != html_extract.DROPPED)


def test_main_text_of_a_page():
    assert text_of(PAGE) == "Title & more\nOne two three € x\nOpen\nDiv boldtext\na\nb\ntail"
    assert text_of(None) == text_of("") == text_of("<p") == ""
    assert text_of("a < b <p>c &am") == "a < b\nc &am" and text_of("<p>x</p><script>never closed") == "x"
    assert text_of('<p title="x>b</p><p>c</p>') == "b\nc" and text_of('<p title="a>b">c') == "c" and text_of("<a href='x>y") == "y"
    assert text_of("<div>x</div><div role='main'><div class='post-header'><h2>T</h2>by</div>y</div>") == "T\ny"
    assert text_of("<div class='menu'>m<div>n</div></div>rest<div>deep" * 3).count("m") == 0
    assert text_of("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_neighbours_take_template_lines_away(spark, monkeypatch):
    page = lambda n: f"<div>Shared top</div><p>Story number {n} is told here at some length.</p><p>And it ends like {n * n}.</p><div>Shared end</div>"
    rows = [(i, f"http://a.com/{i:03d}", page(i)) for i in range(40)] + [(100, "http://b.com/1", page(1)), (101, None, page(2)), (102, "http://c.com/1", page(7)), (103, "http://c.com/2", page(7)), (104, "http://d.com", None), (3, "http://a.com/003", page(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "key", "gone", "blocks")}).repartition(5)
    got = {}
    for r in html_extract.main_text(pages).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    own = lambda n: f"Story number {n} is told here at some length.\nAnd it ends like {n * n}."
    for i in range(40):
        assert got[i][0] == (own(i), len(own(i)))
    whole = lambda n: f"Shared top\n{own(n)}\nShared end"
    assert len(got[3]) == 2 and got[100][0][0] == whole(1) and got[101][0][0] == whole(2), "no neighbour of their host"
    assert got[102][0][0] == got[103][0][0] == whole(7), "copies say nothing about each other"
    assert got[104] == [("", 0)] and html_extract.main_text(pages.where("false")).count() == 0


def test_menus_do_not_make_a_neighbour_a_copy(spark):
    body = lambda n: f"Body {n} " + " ".join(f"word{n}x{k}" for k in range(25))
    page = lambda n: f"<nav>{'menu item ' * 300}</nav><div>Slogan of the site</div><p>{body(n)}</p><footer>{'foot ' * 50}</footer>"
    rows = [(i, f"http://a.com/{i}", page(i)) for i in range(4)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: body(i) for i in range(4)}


def test_runs_of_copies_lose_template_lines_alike(spark):
    """Five copies under other URLs and with other menus, between two pages of their host."""
    page = lambda n, menu: f"<nav>{menu}</nav><div>Shared top</div><p>Story {n} is told here at some length, to its end.</p>"
    rows = [(0, "http://a.com/0", page(0, "m")), *((i, f"http://a.com/{i}", page(1, f"m{i}")) for i in range(1, 6)), (6, "http://a.com/6", page(2, "m")), (7, "http://b.com/1", page(1, "m"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    own = lambda n: f"Story {n} is told here at some length, to its end."
    assert got == {0: own(0), **{i: own(1) for i in range(1, 6)}, 6: own(2), 7: f"Shared top\n{own(1)}"}


def test_articles_keep_lines_that_others_share(spark):
    rows = [(i, f"http://a.com/{i}", f"<nav>m</nav><article><p>Same line</p><p>{i}</p></article>") for i in range(6)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"Same line\n{i}" for i in range(6)}


def test_differencing_without_any_structure(monkeypatch):
    """Menus, notices and footers of a site go because its pages share them, with no tag or word that tells."""
    for name in ("DROPPED_TAGS", "DROPPED_WORDS", "MAIN_TAGS"):
        monkeypatch.setattr(html_extract, name, set())
    body = lambda n: f"Story {n} of the day, told at length\nIt ends after {n * 7} words"
    page = lambda n: f"<nav><ul><li>Home<li>News<li>Page {n} menu</ul></nav><article><p>{body(n).replace(chr(10), '<p>')}</article><aside>Also read</aside><footer>All rights reserved</footer>"
    rows = [(i, f"http://a.com/{i:03d}", page(i)) for i in range(30)]
    lines = [html_extract.blocks(html) for _, _, html in rows]
    for one, two in zip(lines, lines[1:]):
        texts, kinds, other = [t for t, _ in one], bytes(k for _, k in one), [hash(t) for t, _ in two]
        gone = html_extract.shared_lines([hash(t) for t in texts], kinds, [len(t) for t in texts], other)
        assert set(kinds) == {html_extract.OPEN} and [texts[i] for i in gone] == ["Home", "News", "Also read", "All rights reserved"]


def test_stripped_articles_give_the_same_text(spark):
    """The table's pages without their article tags: differencing and marks alone find the text."""
    pages = pages_of(spark)
    tagged = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    plain = {r["page_id"]: r["text"] for r in html_extract.main_text(pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))).collect()}
    same_ = sum(plain[i] == r["text"] for i, r in tagged.items())
    assert same_ >= 0.95 * len(tagged)
    assert sum(r["n_shared"] for r in tagged.values()) > 0, "lines of the given pages go by differencing"


def test_texts_travel_without_dropped_blocks_and_packed():
    menu, line = "menu entry " * 2000, "a line of text that stays "
    page = f"<nav>{menu}</nav>" + "".join(f"<p>{line}{k}</p>" for k in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array(["http://a.com/x"]), pa.array([page])], names=["id", "key", "url", "html"])
    (sent,) = html_extract._texts(iter([batch]))
    assert sent.nbytes < 200 * len(line) / 2
    gone = pa.RecordBatch.from_arrays([*(sent.column(c) for c in ("id", "url", "packed", "places", "n_blocks")), pa.array([[0, 1, 200]], pa.list_(pa.int32()))], names=["id", "url", "packed", "places", "n_blocks", "gone"])
    (row,) = next(html_extract._left(iter([gone]))).to_pylist()
    assert row == {"id": 1, "url": "http://a.com/x", "text": "\n".join(f"{line}{k}" for k in range(1, 199)), "n_blocks": 201, "n_shared": 3}


def test_all_pages_of_the_table(spark):
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages_of(spark)).collect()}
    for r in pages_of(spark).collect():
        assert got[r["page_id"]] == text_of(r["html"]) and got[r["page_id"]]


@pytest.mark.parametrize("bits", [html_extract.LCS_BITS, 12, 0])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_extract, "LCS_BITS", bits)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[i] in rest for i in found)


def test_deep_nesting_and_long_pages_take_linear_time():
    began = time.perf_counter()
    assert text_of("<div>" * 200_000 + "x" + "</b></span></section>" * 50_000) == "x"
    a, b = list(range(40_000)), list(range(20_000, 60_000))
    assert html_extract.common_lines([-1, *a], [-2, *b]) == list(range(20_001, 40_001))
    assert time.perf_counter() - began < 20


# --- nearest neighbours


def brute(ids, x, query, own, k):
    scores = [sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, query)) for v in x]
    return sorted(((-s, int(i)) for i, s in zip(ids, scores) if i != own))[:k]


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    got = ann.self_search(spark.read.parquet(f"{DATA}/embeddings.parquet")).toPandas()
    x, hits, total = [np.asarray(v, np.float64) for v in rows.embedding], 0, 0
    for own in rows.vec_id[rows.vec_id % 20 == 0]:
        want = brute(rows.vec_id, x, x[int(np.flatnonzero(rows.vec_id == own)[0])], own, 20)
        mine = got[got.query_id == own].sort_values("rank")
        exact = dict((i, -s) for s, i in brute(rows.vec_id, x, x[int(np.flatnonzero(rows.vec_id == own)[0])], own, 10**6))
        assert mine["rank"].tolist() == list(range(1, 21)) and all(abs(exact[i] - s) < 1e-12 for i, s in zip(mine.vec_id, mine.score))
        hits, total = hits + len({i for _, i in want} & set(mine.vec_id)), total + 20
    assert hits / total >= 0.9


def test_vectors_of_all_lengths_ties_and_unusable_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8) * rng.choice([0.1, 1, 5])]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(30)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] * 8), (2080, [float("inf")] + [1.0] * 7), (2100, [None] + [1.0] * 7), (2120, [1.0, 2.0]), (2140, [2.0, 1.0]), (None, rows[0][1]), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "shard", "dim", "score", "rank")})
    got = ann.self_search(df).toPandas()
    usable = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    assert set(got.query_id) == {i for i, v in usable if i % 20 == 0}
    hits = total = 0
    for own, query in usable:
        if own % 20:
            continue
        near = {i: v for i, v in usable if len(v) == len(query)}
        want = [i for _, i in brute(list(near), list(near.values()), query, own, 20)]
        mine = got[got.query_id == own].sort_values("rank").vec_id.tolist()
        hits, total = hits + len(set(want) & set(mine)), total + len(want)
        if own == 40:
            assert mine[:5] == want[:5]
    assert hits / total >= 0.9
    assert ann.self_search(df.where("false")).count() == 0


def clustered(n=6000):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    return (centres[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, 32))).astype(np.float32)


def recall(got, x, queries, k=20):
    """``got``: {query: ids}."""
    hits = 0
    for q in queries:
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:k].tolist()) & set(got[q]))
    return hits / (k * len(queries))


def forest_share(x, queries):
    f = ann.Forest(np.arange(len(x)), x, float(np.linalg.norm(x, axis=1).max()))
    found = [r for a in range(0, len(queries), 64) for r in f.search(queries[a : a + 64], x[queries[a : a + 64]], 20)]
    return recall({q: r[0].tolist() for q, r in zip(queries.tolist(), found)}, x, queries), f.scored / len(queries) / len(x)


def test_forest_scores_few_vectors():
    table = np.stack(pd.read_parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet").embedding.to_list()).astype(np.float32)
    found, share = forest_share(table, np.arange(0, len(table), 20))
    assert found >= 0.9 and share < 0.6, "directions without near neighbours"
    x = clustered()
    found, share = forest_share(x, np.arange(0, len(x), 60))
    assert found >= 0.9 and share < 0.1


def shards_of(spark, df, n):
    """How many shards a search with shards of ``n`` vectors has."""
    held = df.selectExpr("vec_id as id", "embedding as v", "size(embedding) as dim", "sqrt(aggregate(embedding, 0D, (s, x) -> s + x * x)) as length")
    return ann.deals(held, n)


@pytest.mark.parametrize("table", ["given", "clustered"])
def test_recall_over_several_shards(spark, table):
    if table == "given":
        df = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet").select("vec_id", "embedding")
        x = np.stack(df.orderBy("vec_id").toPandas().embedding.to_list())
    else:
        x = clustered()
        df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    deal = next(iter(shards_of(spark, df, len(x) // 8).values()))
    assert len(deal.starts) >= 4
    got = ann.self_search(df, shard=len(x) // 8).toPandas()
    queries = np.arange(0, len(x), 20)
    assert recall(got.groupby("query_id").vec_id.agg(list).to_dict(), x, queries) >= 0.9
    assert got.groupby("query_id").size().eq(20).all() and (got.groupby("query_id")["rank"].max() == 20).all()
    if table == "clustered":
        kth = got[got["rank"] == 20].sort_values("query_id").score.to_numpy()
        asked = [len(c) for c in deal.others(x[queries], kth, ann.ROUTE_MISS)]
        assert np.mean(asked) < 0.6 * len(deal.starts), "queries with near neighbours leave shards out"


def test_crowded_prefixes_split_and_equal_vectors_are_dealt_by_id(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.tile(rng.normal(size=16), (600, 1)), rng.normal(size=16) + 0.01 * rng.normal(size=(600, 16)), rng.normal(size=(600, 16))]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    deal = shards_of(spark, df, 50)[16]
    assert deal.parts.max() >= 6 and deal.depths.max() == ann.DEAL_BITS and len(set(deal.depths.tolist())) > 1
    got = ann.self_search(df, shard=50).toPandas()
    for q in range(0, 600, 100):
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine.score.nunique() == 1 and mine.vec_id.tolist() == sorted(mine.vec_id)
    assert recall(got.groupby("query_id").vec_id.agg(list).to_dict(), x, np.arange(600, 1800, 20)) >= 0.9


def test_queries_go_to_many_cells_in_bounded_blocks():
    """2,000 queries and 4,096 cells: under 80 MB (one array of all their pairs has 66), and the same rows whatever the size of a block."""
    import tracemalloc
    from types import SimpleNamespace

    rng = np.random.default_rng(12)
    cells = np.arange(4096, dtype=np.uint64)
    deal = ann.Deal(64, 1.0, cells << np.uint64(ann.DEAL_BITS - 12), np.full(4096, 12), np.full(4096, 100), np.ones(4096, np.int64))
    x = rng.normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def rows(n, kth):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64), pa.int32()), pa.array(x[:n].reshape(-1)))
        return ann._deal(SimpleNamespace(value={64: deal}), True, 0.03)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(n)), flat, pa.array(np.full(n, kth))], names=["id", "v", "kth"])]))

    tracemalloc.start()
    sent = sum(b.num_rows for b in rows(len(x), 0.97))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent > 0 and peak < 80 << 20
    whole, held = [], ann.ROUTE_PAIRS
    try:
        for ann.ROUTE_PAIRS in (held, 5 * 4096):
            whole.append([(a, b) for batch in rows(40, 0.9) for a, b in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist())])
    finally:
        ann.ROUTE_PAIRS = held
    assert sorted(whole[0]) == sorted(whole[1]) and len(whole[0]) > 40
