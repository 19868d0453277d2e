from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute_kept
from tests.oracle import DATA, duck
from shardwright.llm.contamination_sql import CONTAMINATION_SQL
from shardwright.llm.mixing import mixing_sql


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen, at = docs.columns, {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, DATA).write.parquet(str(tmp_path / str(k)))
        before, at = at, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (before.toPandas(), at.toPandas())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
    before, after = seen["language"]
    assert len(after) >= 0.99 * len(before) and (after.lang == before.set_index("doc_id").lang.reindex(after.doc_id).values).mean() > 0.98
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id").quality
    bad = [i for i in before.doc_id if labels.get(i) == 0]
    good = [i for i in before.doc_id if labels.get(i) == 1]
    assert len(set(bad) & set(after.doc_id)) <= 0.1 * len(bad) and len(set(good) & set(after.doc_id)) >= 0.97 * len(good)
    before, after = seen["near_dedup"]
    # The rule of stages without a contract: five words, a similarity of 0.8 or more.
    assert sorted(after.doc_id) == brute_kept(list(zip(before.doc_id, before.text)))
    before, after = seen["decontamination"]
    names, rows = duck(CONTAMINATION_SQL, {"documents": before})
    clean = [r[names.index("doc_id")] for r in rows if not r[names.index("contaminated")]]
    assert sorted(after.doc_id) == sorted(clean)
    before, after = seen["mixing"]
    names, rows = duck(mixing_sql(), {"documents": before})
    keys = ("doc_id", "epoch", "block", "block_rank", "position")
    assert sorted(tuple(r[names.index(c)] for c in keys) for r in rows) == sorted(after[list(keys)].itertuples(index=False, name=None))
    assert (after.text == before.set_index("doc_id").text.reindex(after.doc_id).values).all()


def test_stages_survive_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "the and of is the in", "en", "a"), (3, "the and of is the in", "en", "a"), (None, "the and of", "en", None), (4, "der die das und ist", "de", "b"), (5, "x " * 50_000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("n_chars", "_lang", "_score", "_n", "_hit_ranges", "weight", "epoch")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for part, label in ((docs, "odd"), (docs.where("false"), "none")):
            stage(spark, part, DATA).write.parquet(str(tmp_path / f"{k}{label}"))
            assert label == "odd" or spark.read.parquet(str(tmp_path / f"{k}{label}")).count() == 0


def test_run_is_the_query(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["pipeline"](spark, DATA)
    assert got.count() > 0 and {"doc_id", "text", "source", "epoch", "position"} <= set(got.columns)
    assert __spark_entry__.oracle_sql().get("pipeline") == corpus_pipeline.ORACLE_SQL
