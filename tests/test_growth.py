"""What steps write and read, so that large inputs fit: rows that go to disk, passes over files, sizes of batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shardwright import session
from shardwright.operators import classify, link, repair, report, rescue, salvage
from shardwright.sources import archives, containers
from tests.oracle import DATA


def test_pairs_of_files_are_scored_without_rows_for_their_parts(spark, monkeypatch):
    # 60 files of one size share 40 of 41 names each; two pairs of other sizes are lineages, one by media, one by plain parts.
    rows = [(f, f"n{k}", f"{f}-{k}" if k < 20 else "same", 10, False) for f in range(60) for k in range(40)] + [(f, f"own{f}", "x", 10, False) for f in range(60)]
    rows += [(f, f"p{k}", f"c{k}" if k else f"odd{f}", 5, False) for f in (70, 71) for k in range(10)]
    rows += [(f, f"m{k}", f"d{k}", 5, True) for f in (80, 81) for k in range(4)] + [(81, "more", "e", 5, False), (90, None, "e", 5, False)]
    parts = spark.createDataFrame(rows, "file_id long, name string, crc string, comp_size long, media boolean")
    files = spark.createDataFrame([(f, 1000 if f < 60 else 2000 + f) for f in {r[0] for r in rows}] + [(95, 1000)], "file_id long, size long")
    written = []
    monkeypatch.setattr(link, "stored", lambda df, label="table": written.append((label, df.count())) or df)
    got = link.origin_scores(parts, files)
    found = {(r["target"], r["donor"]): r for r in got.collect()}
    assert len(found) == 60 * 59 + 4 and {r["tier"] for r in found.values()} == {"candidate", "lineage"}
    assert found[3, 7]["tier"] == "candidate" and found[3, 7]["name_ratio"] == 40 / 41 and found[3, 7]["triple_ratio"] == 20 / 41
    assert found[71, 70]["triple_ratio"] == 0.9 and abs(found[70, 71]["lineage_score"] - (0.6 * 0.9 + 0.4)) < 1e-12
    assert found[80, 81]["media_ratio"] == 1.0 and abs(found[81, 80]["lineage_score"] - (0.5 + 0.3 * 0.8 + 0.2 * 0.8)) < 1e-12
    # A row a file, or one for each rare part that files share: never one for each part of each file, or one for each pair of a size.
    assert all(n <= 20 * 60 for _, n in written) and dict(written)["facts"] == 65, written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _packages(spark, n=26):
    return containers.known_packages(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))).select(F.col("doc_id").alias("file_id"), "content")


def test_python_gets_files_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    files = spark.range(0, 40, 1, 1).select(F.col("id").alias("file_id"), F.repeat(F.lit("q"), 1 << 20).cast("binary").alias("content"))
    classify.read_packages(files)

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], names=["n"])

    assert files.mapInArrow(largest, "n long").agg(F.max("n")).first()[0] <= 6 << 20
    rows = spark.range(0, 40, 1, 1).select(F.concat(F.lit("box"), "id", F.lit(".zip")).alias("path"), F.lit("a.pptx").alias("member"), F.repeat(F.lit("q"), 1 << 20).cast("binary").alias("content"))
    assert archives.list_archives(containers.archived(rows)).count() == 40


def test_reports_and_rescue_pass_files_once_and_never_shuffle_them(spark):
    files = _packages(spark).localCheckpoint()
    assert _plan(report.text_lines(classify.diagnose(files), "file_id")).count("MapInArrow") == 1
    rescued = rescue.rescue(files, classify.diagnose(files, keep=True))
    assert "Join" not in _plan(rescued)  # only rows of carved images meet
    apart = rescue.rescue(files, classify.diagnose(files))
    assert sorted(map(tuple, rescued.collect())) == sorted(map(tuple, apart.collect()))


def test_repair_writes_files_twice_and_entries_never(spark, monkeypatch):
    labels, write = [], repair.stored
    monkeypatch.setattr(repair, "stored", lambda df, label="table": labels.append(label) or write(df, label))
    _, made = repair.made_packages(_packages(spark))
    assert labels == ["plan", "repaired"] and made.where("mode = 'rebuild'").count() == 6


def test_long_sets_of_one_list_are_told_apart_before_they_are_paired():
    from shardwright.llm import near_copies as N

    rng = np.random.default_rng(1)
    fresh = lambda n: np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    sets = [fresh(3000) for _ in range(30)]
    sets.append(np.unique(np.concatenate([sets[0][:2800], fresh(150)])))  # similar to the first one
    sets.sort(key=len)
    n = range(len(sets))
    batch = pa.RecordBatch.from_arrays([
        pa.array([7] * len(sets)), pa.array([len(x) for x in sets], pa.int32()), pa.array(n), pa.array(n), pa.array([N.parities(x, N.MARKS).view(np.int64).tolist() for x in sets], pa.list_(pa.int64())),
        pa.array([-1] * len(sets), pa.int32()), pa.array([N.long_marks(x) for x in sets], pa.binary()),
    ], names=["key", "size", "fp", "root", "marks", "side", "long"])
    alike = {(a, b) for a in n for b in n if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    got = {p for b in N._close(0.8)(iter([batch])) for p in zip(*b.to_pydict().values())}
    assert len(alike) == 1 and alike <= got and len(got) <= 10, len(got)
    assert N.long_marks(fresh(900)) is None and len(N.long_marks(fresh(20_000))) == N.LONG_MARKS // 8


def test_equal_parts_are_parsed_once_and_cleaned_parts_are_read_not_made_twice(spark):
    """Before, reconciled_timing cleaned every part twice: three kernels in its plan."""
    from shardwright.functions import xmltree
    from shardwright.plans import flow_queries

    parsed = []
    judge = lambda data, alive: parsed.append(data) or (data, sorted(alive))
    got = [xmltree.once(judge, data, frozenset(alive)) for data, alive in ((b"<a/>", "x"), (b"<a/>", "x"), (b"<a/>", "y"), (b"<b/>", "x"), (b"<a/>", "x"))]
    assert got == [(b"<a/>", ["x"]), (b"<a/>", ["x"]), (b"<a/>", ["y"]), (b"<b/>", ["x"]), (b"<a/>", ["x"])] and len(parsed) == 3
    large = b"x" * (xmltree.SMALL + 1)
    assert [xmltree.once(len, large) for _ in range(2)] == [len(large)] * 2
    plan = flow_queries.reconciled_timing(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_entries_are_sorted_by_tasks_of_bounded_size(spark, monkeypatch):
    assert [session.dealt(n << 20, 8) for n in (0, 1, 9, 36, 216, 3600)] == [8, 8, 36, 144, 200, 900]
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    entries = spark.range(40_000).select((F.col("id") % 4000).alias("file_id"), F.concat(F.lit("e"), "id").alias("name"), F.col("id").alias("header_offset"))
    got = salvage.entry_intervals(entries, spark.range(4000).select(F.col("id").alias("file_id"), F.lit(50_000).cast("long").alias("cd_start")))
    held = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 40_000 and max(held) < 2000, held
    assert got.where("not layout_ok").count() == 0
