import io
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shardwright.functions import names as N
from shardwright.functions import zipbytes
from shardwright.operators import classify, diagnostics, integrity, link, merge, repair
from shardwright.sources import archives, containers, discover, packages


def files_of(spark, contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "file_id long, content binary")


def verdicts(spark, contents):
    return [r["verdict"] for r in classify.diagnose(files_of(spark, contents)).orderBy("file_id").collect()]


@pytest.mark.parametrize("recipe", containers.RECIPES)
def test_recipes_get_their_verdict(spark, recipe):
    assert verdicts(spark, [containers.damaged(recipe, "some text", "seed")]) == [recipe]


def test_thresholds_and_odd_files(spark):
    whole = containers.damaged("normal", "t", "s")
    cfb = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(600)
    stray = cfb + b"PK\x03\x04" + b"x" * 50
    assert verdicts(spark, [whole + b"x" * 60_000, cfb, stray, b"text", None, whole[: len(whole) // 2]]) == ["normal", "not_a_zip", "not_a_zip", "not_a_zip", None, "tail_truncated"]
    rows = classify.diagnose(files_of(spark, [None, whole])).orderBy("file_id").collect()
    assert rows[0]["read_error"] and not rows[0]["corrupted"]
    assert classify.exit_code(classify.diagnose(files_of(spark, [None]))).first()[0] == 2
    assert classify.exit_code(classify.diagnose(files_of(spark, [whole]))).first()[0] == 0


def test_version_mix_needs_five(spark):
    """The old entries and the last new one stand where the index lists nothing: five are a mix, four are not."""
    for n, expected in ((4, "version_mix"), (3, "interior_damage")):
        old = containers.stored([(f"o{k}", b"data" * 9) for k in range(n)])
        new = containers.stored([("y" * 30, b"w" * 50), ("z" * 40, b"v" * 50)])
        body = old[: old.index(b"PK\x01\x02")]
        tail = new[: new.index(b"PK\x01\x02")]
        listed = body + tail
        index = new[new.index(b"PK\x01\x02") :]
        moved = bytearray(containers._moved(index, len(listed)))
        first = moved.index(b"PK\x01\x02")
        second = moved.index(b"PK\x01\x02", first + 4)
        moved[first + 42 : first + 46] = len(body).to_bytes(4, "little")
        moved[second + 42 : second + 46] = (5).to_bytes(4, "little")
        assert verdicts(spark, [listed + bytes(moved)]) == [expected]


def test_zero_runs_to_the_byte():
    data = b"a" * 5000 + bytes(10_000) + b"b" * 100
    assert zipbytes.zero_runs(data) == [(5000, 15_000)]
    assert zipbytes.zero_runs(b"a" + bytes(4095) + b"b" * 4096) == []
    assert zipbytes.zero_runs(bytes(100)) == [(0, 100)] and zipbytes.zero_runs(b"") == []


def test_streamed_entries_are_read():
    buffer = io.BytesIO()

    class Pipe(io.RawIOBase):
        def writable(self):
            return True

        def write(self, b):
            buffer.write(b)
            return len(b)

    with zipfile.ZipFile(Pipe(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "again " * 50)
    data = buffer.getvalue()
    assert [(e["name"], e["ok"], e["file_size"]) for e in zipbytes.header_entries(data)] == [("a.txt", True, 300), ("b.txt", True, 300)]
    cut = data[: data.index(b"PK\x07\x08") - 3]
    assert [e["error"] for e in zipbytes.header_entries(cut)] == ["Truncated"]
    broken = bytearray(data)
    broken[-len(data) + 40] ^= 0xFF
    assert not zipbytes.header_entries(bytes(broken))[0]["ok"]


def test_names(spark):
    one = lambda **c: spark.range(1).select(*(v.alias(k) for k, v in c.items())).first()
    r = one(
        a=N.suffix(F.lit(".pptx")), b=N.suffix(F.lit("x.PPTX")), c=N.resolved(F.lit("ppt/slides"), F.lit("../media/i.png")), d=N.resolved(F.lit("x"), F.lit("/ppt/a.xml")),
        e=N.rels_name(F.lit("ppt/slides/s.xml")), f=N.rels_base(F.lit("ppt/slides/_rels/s.xml.rels")), g=N.rels_base(F.lit("_rels/.rels")), h=N.alignment(F.lit(0)), i=N.alignment(F.lit(4097)),
        j=N.dos_datetime(F.lit(0x5821), F.lit(0x6000)), k=N.dos_datetime(F.lit(0x5800), F.lit(0)), l=N.strict_base64(F.lit("aGk=\n")), m=N.strict_base64(F.lit("***")), n=N.is_unsafe_path(F.lit("a/../b")), o=N.local_name(F.lit("{urn:x}tag")), p=N.flat_xml_name(F.lit("ppt/slides/slide1.xml")),
    )
    assert (r.a, r.b, r.c, r.d) == ("", ".pptx", "ppt/media/i.png", "ppt/a.xml")
    assert (r.e, r.f, r.g, r.h, r.i) == ("ppt/slides/_rels/s.xml.rels", "ppt/slides", "", 1 << 20, None)
    assert str(r.j) == "2024-01-01 12:00:00" and r.k is None and bytes(r.l) == b"hi" and r.m is None and r.n and r.o == "tag" and r.p == "ppt__slides__slide1.partial.xml"


def test_discovery_sees_hidden_and_empty_files(spark, tmp_path):
    for name, data in (("a.pptx", b"1"), (".hid/c.pptx", b"2"), ("empty.pptx", b""), ("_u.pptm", b"3"), ("~$a.pptx", b"4"), ("old.ppt", b"5"), ("b.tar.gz", b"6"), ("n.txt", b"7"), ("sub/.h.pptx", b"8")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "loop").symlink_to(tmp_path)
    found = {r["path"].removeprefix(f"{tmp_path}/"): r["bucket"] for r in discover.discover(spark, [str(tmp_path), "/nowhere/at/all"], ignore_hidden=True, exclude=(f"{tmp_path}/old.ppt",)).collect()}
    assert found == {"a.pptx": "targets", ".hid/c.pptx": "targets", "empty.pptx": "targets", "_u.pptm": "targets", "~$a.pptx": "skipped_temp", "b.tar.gz": "archives", "sub/.h.pptx": "skipped_hidden", "/nowhere/at/all": "errors"}
    assert discover.discover(spark, [str(tmp_path)], follow_symlinks=True).where("bucket = 'targets'").count() == 5
    read = discover.with_content(discover.discover(spark, [str(tmp_path)]).where("bucket = 'targets'"))
    assert {bytes(r["content"]) for r in read.collect()} == {b"1", b"2", b"", b"3", b"8"}


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("d/x.pptx", b"one")
        f.writestr("~$x.pptx", b"no")
        f.writestr("inner.zip", b"no")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("y.pptm")
        info.size = 3
        f.addfile(info, io.BytesIO(b"two"))
    note = b"<en-export><note><title>T</title><resource><data>dGhyZWU=</data><mime>application/vnd.openxmlformats-officedocument.presentationml.presentation</mime></resource><resource><data>!!</data><mime>x/y</mime><resource-attributes><file-name>z.pptx</file-name></resource-attributes></resource></note></en-export>"
    rows = [("a.zip", bytearray(z.getvalue())), ("b.tgz", bytearray(t.getvalue())), ("c.enex", bytearray(note)), ("d.zip", bytearray(b"junk")), ("e.pptx", bytearray(b"x"))]
    got = {(r["path"], r["member"]): (bytes(r["content"]) if r["content"] is not None else None, r["note"]) for r in archives.mine_archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got[("a.zip", "d/x.pptx")] == (b"one", None) and got[("b.tgz", "y.pptm")] == (b"two", None) and got[("c.enex", "T/resource1.pptx")] == (b"three", None)
    assert got[("c.enex", "T/z.pptx")] == (None, "bad base64") and got[("d.zip", None)][1].startswith("archive ends early") and len(got) == 5


def test_parts_round_trip_and_rebuild(spark):
    whole = containers.damaged("normal", "hello & bye", "s")
    cut = whole[: whole.index(b"ppt/slides/slide3.xml") - 30]
    files = files_of(spark, [cut])
    out = repair.repair(files).first()
    assert (out["verdict"], out["mode"], out["after"]) == ("tail_truncated", "rebuild", "normal")
    parts = packages.read_parts(files_of(spark, [bytes(out["content"])]))
    assert parts.where("name = 'ppt/slides/slide3.xml'").isEmpty()
    deck = bytes(parts.where("name = 'ppt/presentation.xml'").first()["payload"]).decode()
    assert 'r:id="rId2"' in deck and 'r:id="rId3"' not in deck
    rels = integrity.relationships(parts)
    assert integrity.dangling_references(integrity.references(parts), rels).where("part = 'ppt/presentation.xml'").isEmpty()
    assert repair.slide_texts(parts).where("slide = 1").first()["text"] == "hello & bye"
    assert {r["folder"] for r in repair.extracted(parts).collect()} == {"parts"} | ({"media"} if not parts.where("name like 'ppt/media/%'").isEmpty() else set())


def test_crossover_and_identical(spark):
    big = containers.stored([("a.bin", containers.filler("a", 300_000)), ("b.bin", b"end")])
    one, two = bytearray(big), bytearray(big)
    one[200_000:200_100] = bytes(100)
    two[70_000:70_100] = bytes(100)
    rows = spark.createDataFrame([(1, 1, one), (1, 2, two), (2, 1, bytearray(big)), (2, 2, bytearray(big)), (3, 1, bytearray(b"no"))], "group_id int, copy_rank int, content binary")
    got = {(r["group_id"], r["name"]): (r["method"], r["sources"]) for r in merge.splice(rows).collect()}
    assert got[(1, "a.bin")] == ("crossover", [1, 2]) and got[(1, "b.bin")] == ("splice", [1]) and got[(2, "a.bin")] == ("splice", [1])
    assert [tuple(r) for r in merge.identical(rows).collect()] == [(2, 2, 1)]
    done = {r["group_id"]: r for r in merge.restore(rows).collect()}
    assert bytes(done[1]["content"]) == big and done[3]["guarantee"] == "failed"


def test_restored_bytes_equal_the_original(spark):
    texts = spark.createDataFrame([(5, "hello")], "doc_id long, text string")
    row = merge.restore(containers.complementary_copies(texts)).first()
    assert row["guarantee"] == "full" and bytes(row["content"]) == containers.package(["hello", "5", "third"], containers.filler("5", 9000))


def test_carving(spark):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", containers.filler("p", 9000)) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x10" + b"J" * 14 + b"\xff\xda\x00\x08" + b"s" * 6 + containers.filler("j", 9000).replace(b"\xff", b"\xfe") + b"\xff\xd9"
    data = b"head" + png + b"gap" + jpeg + png + png[:500]
    got = [(r["kind"], r["offset"], r["length"]) for r in repair.carve(files_of(spark, [data, b"", None])).orderBy("image_no").collect()]
    assert got == [("png", 4, len(png)), ("jpeg", 7 + len(png), len(jpeg))]


def test_hot_name_costs_a_fixed_number_of_rows(spark):
    files = spark.range(3000).select(F.col("id").alias("file_id"), F.lit("same.pptx").alias("name"), (F.col("id") % 7).alias("size"), (F.col("id") % 2 == 0).alias("normal"))
    got = link.twin_candidates(files.union(spark.createDataFrame([(9000, None, None, False)], "file_id long, name string, size long, normal boolean")))
    assert got.groupBy("target").count().agg(F.min("count"), F.max("count")).first()[:] == (10, 10)
    front = link._front(files.where("normal").select("file_id", "name", "size"), "name", "size", 10)
    assert front.count() <= 110


def test_profile_and_fingerprints(spark):
    data = bytes(65536) + (b"text " * 13108)[:65536] + containers.filler("r", 65536)
    profile = diagnostics.chunk_profile(files_of(spark, [data, b""]))
    assert [r["layout"] for r in diagnostics.layouts(profile).collect()] == ["zeros>text_like>high_entropy"]
    judged = classify.diagnose(files_of(spark, [b"plain", containers.damaged("normal", "t", "s")]))
    rows = diagnostics.fingerprints(judged, "file_id").collect()
    assert len(rows) == 1 and '"verdict":"not_a_zip"' in rows[0]["fingerprint"]


def test_stream_scans_each_file_once(spark, tmp_path):
    from shardwright.streaming.incremental import diagnose_stream

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pptx").write_bytes(containers.damaged("normal", "t", "s"))
    run = lambda: diagnose_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (source / "b.pptx").write_bytes(containers.damaged("tail_truncated", "t", "s"))
    run()
    run()
    assert sorted(r["verdict"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["normal", "tail_truncated"]


def test_mixes_of_three_copies_and_short_ones():
    """Every copy is the only one with its third; then one copy ends early."""
    from shardwright.operators import merge

    body = bytes(range(256)) * 768  # three switches of 64 KiB
    whole = zipped([("a.bin", body)], stored=True)
    end = whole.index(b"PK\x01\x02")
    segment, crc = whole[:end], zlib.crc32(body)
    cuts = [0, 65536, 131072, end]
    copies = [bytes(a) + segment[a:b] + bytes(end - b) for a, b in zip(cuts, cuts[1:])]
    found, capped = merge._crossover(copies, 0, "a.bin", crc)
    assert found == (segment, [0, 1, 2]) and not capped
    copies = [segment[:70_000], bytes(65536) + segment[65536:]]
    assert merge._crossover(copies, 0, "a.bin", crc) == ((segment, [0, 1]), False)
    assert merge._crossover([bytes(end)] * 3, 0, "a.bin", crc) == (None, False)


def zipped(parts, stored=False):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in parts:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return buffer.getvalue()


def test_rebuilt_packages_keep_to_the_salvage_policy(spark):
    """A fragment that the index does not list stays out of a deck whose index can be trusted."""
    from shardwright.operators import repair
    from shardwright.sources.containers import damaged
    from shardwright.sources.packages import read_parts

    data = damaged("interior_damage", "text", "8")
    stray = zipped([("ppt/slides/slide1.xml", b"<stray/>")], stored=True)
    gap = data.index(bytes(300))  # the zeroed entry
    inside = stray[: stray.index(b"PK\x01\x02")]
    data = data[: gap + 1] + inside + data[gap + 1 + len(inside) :]
    made = repair.repair(spark.createDataFrame([(1, bytearray(data))], "file_id long, content binary")).first()
    names = [r["name"] for r in read_parts(spark.createDataFrame([(1, made["content"])], "file_id long, content binary")).collect()]
    assert made["after"] == "normal" and "ppt/slides/slide1.xml" not in names and "ppt/slides/slide2.xml" in names


def test_titles_paragraphs_and_references(spark):
    from shardwright.functions import names as N

    row = spark.range(1).select(
        N.unescaped(F.lit("&amp;#38; &#38;amp; &#xe9;&#233; &#xD800; &#0; &unknown;")).alias("a"),
        N.paragraphs(F.lit("<a:p><a:r><a:t>one </a:t></a:r><a:r><a:t>line</a:t></a:r></a:p><a:p/><a:p><a:t>two</a:t></a:p>")).alias("b"),
        N.part_type(F.lit("ppt/slides/slide7.xml")).alias("c"), N.part_type(F.lit("ppt/media/a.png")).alias("d"), N.default_type(F.lit("PNG")).alias("e"),
    ).first()
    assert row["a"] == "&#38; &amp; éé &#xD800; &#0; &unknown;" and row["b"] == ["one line", "two"]
    assert row["c"].endswith("presentationml.slide+xml") and row["d"] is None and row["e"] == "image/png"
