import os
import random

import pytest
from pyspark.sql import functions as F

from shardwright.functions import zipbytes
from shardwright.sources import containers, discover, frontier, ranges


def plain(value):
    """Rows as dicts, all the way down."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def odd_files():
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(1, 256) for _ in range(n))
    end = b"PK\x05\x06" + bytes(18)
    return [
        b"", b"\0", bytes(4096), bytes(4097), bytes(40_000), noise(8191) + bytes(8194) + noise(3), noise(4095) + bytes(4096) + noise(5000),
        noise(8190) + b"PK\x03\x04" + noise(10), noise(8189) + b"PK\x01\x02" + noise(8188) + end, noise(8192 - 2) + end, noise(100) + end[:21], end + noise(8170) + b"PK\x05\x06",
        b"PK\x03\x04" * 5000, noise(12_000) + bytes(30_000) + noise(1) + bytes(9000),
    ]


@pytest.mark.parametrize("size", [4096, 8192, 65536])
def test_ranges_give_the_facts_of_the_whole(spark, tmp_path, size):
    contents = odd_files() + [containers.damaged(r, "a text " * 300, "seed") for r in containers.RECIPES]
    for i, c in enumerate(contents):
        (tmp_path / str(i)).write_bytes(c)
    want = {i: zipbytes.structure(c) for i, c in enumerate(contents)}
    files = spark.createDataFrame([(i, str(tmp_path / str(i)), len(c)) for i, c in enumerate(contents)], "file_id long, path string, size long")
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file_id long, content binary")
    for facts in (ranges.facts_of_files(files, size), ranges.facts_of_contents(rows, size)):
        got = {r["file_id"]: plain(r) for r in ranges.structure(facts).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert {k: got[i][k] for k in want[i]} == want[i], i
            assert got[i]["head"] == contents[i][:8] and got[i]["error"] is None


def test_unreadable_ranges_are_rows(spark, tmp_path):
    (tmp_path / "short").write_bytes(b"x" * 5000)
    files = spark.createDataFrame([(1, str(tmp_path / "none"), 10), (2, str(tmp_path / "short"), 9000)], "file_id long, path string, size long")
    got = {r["file_id"]: r for r in ranges.structure(ranges.facts_of_files(files, 4096)).collect()}
    assert got[1]["error"] == "FileNotFoundError" and got[2]["error"] == "OSError" and got[1]["zero_runs"] is None and got[2]["eocd"] is None


def test_index_entries_are_verified_apart(spark, tmp_path):
    for r in containers.RECIPES:
        (tmp_path / r).write_bytes(containers.damaged(r, "text " * 500, "seed"))
    files = spark.createDataFrame([(r, str(tmp_path / r)) for r in containers.RECIPES], "file_id string, path string")
    got = ranges.verified_entries(ranges.listed_entries(files)).collect()
    for r in containers.RECIPES:
        want = zipbytes.index_entries((tmp_path / r).read_bytes()) or []
        have = [{k: x[k] for k in want[0]} for x in got if x["file_id"] == r] if want else [x for x in got if x["file_id"] == r]
        assert sorted(have, key=str) == sorted(want, key=str)


def tree(top):
    for name in ("b/deep/er", "a", "c"):
        os.makedirs(top / name)
    for name in ("z.pptx", "a/1.pptx", "a/.hidden", "b/deep/er/x.zip", "b/deep/2.txt", "c/é.pptx"):
        (top / name).write_bytes(b"x" * len(name))
    os.symlink(top / "b", top / "b/deep/er/back")  # leads to where it came from
    os.symlink(top, top / "a/up")
    os.symlink(top / "z.pptx", top / "c/link.pptx")
    os.symlink(top / "nothing", top / "c/broken")


@pytest.mark.parametrize("follow", [False, True])
def test_levels_list_what_a_plain_walk_lists(spark, tmp_path, follow):
    tree(tmp_path)
    roots = [str(tmp_path), str(tmp_path / "z.pptx"), str(tmp_path / "missing"), str(tmp_path / "b")]
    seen, want = set(), []
    for n, root in enumerate(roots):
        want += [(n, p, s.st_size if s else None, e) for p, s, e in discover.walked(root, follow, seen)]
    if follow:  # the last root was walked as a part of the first; here it is a start, one step away
        inner = os.path.join(str(tmp_path), "b", "")
        want = sorted(((3 if p.startswith(inner) else n, p, s, e) for n, p, s, e in want), key=lambda r: r[0])
    rows = frontier.walk(spark, roots, follow).orderBy("root_no", "walk_key").collect()
    assert [(r["root_no"], r["path"], r["size"], r["error"]) for r in rows] == want
    assert frontier.walk(spark, [str(tmp_path / "c" / "broken")]).first()["error"] == "FileNotFoundError"


def test_a_wide_level_is_dealt_to_tasks(spark, tmp_path):
    for k in range(40):
        os.makedirs(tmp_path / f"d{k}/e")
        (tmp_path / f"d{k}/e/f").write_bytes(b"")
    rows = frontier.walk(spark, [str(tmp_path)])
    assert rows.count() == 40 and rows.where("kind = 'file'").select(F.input_file_name().alias("f")).distinct().count() > 1
