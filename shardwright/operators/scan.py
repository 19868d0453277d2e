"""One scan: files and archives as rows, verdicts, candidates and findings, in one plan whose results are stored once.

Every file and archive member ends as a row with a verdict or an error. Members of archives are
material: they may be donors of damaged files, never targets. Hidden members are kept in the stored
material and filtered where it is used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardwright.functions.names import basename
from shardwright.operators import classify, diagnostics, link
from shardwright.operators.progress import Progress
from shardwright.session import stored
from shardwright.sources.archives import mine_archives

FACTS = ["verdict", "corrupted", "size", "head_kind", "zero_ratio", "zero_runs", "cd_sig_count", "eocd", "cd_total", "cd_ok", "lfh_ok", "foreign_names", "evidence", "salvage", "read_error"]


@dataclass
class Scan:
    """``outcomes``: path and ``FACTS``; ``materials``: archive, member, label, hidden and ``FACTS``; ``notes``: archive, note."""

    outcomes: DataFrame
    materials: DataFrame
    notes: DataFrame
    ignore_hidden: bool

    def used_materials(self) -> DataFrame:
        """Material without the hidden members, where these are ignored."""
        return self.materials.where("not hidden") if self.ignore_hidden else self.materials

    def candidates(self, limit: int = link.TWIN_LIMIT) -> DataFrame:
        """(target, donor, confidence, rank): twins of damaged files among intact files and intact material."""
        own = self.outcomes.select(F.col("path").alias("file_id"), basename(F.col("path")).alias("name"), "size", (F.col("verdict") == "normal").alias("normal")).where("normal is not null")
        lent = self.used_materials().where("verdict = 'normal'").select(F.col("label").alias("file_id"), basename(F.col("member")).alias("name"), "size", F.lit(True).alias("normal"))
        return link.twin_candidates(own.unionByName(lent), limit)

    def fingerprints(self, limit: int = diagnostics.FINGERPRINTS) -> DataFrame:
        """(path, fingerprint, more): texts of the first files of unknown damage, and a last row without a path that counts those beyond."""
        some = diagnostics.fingerprints(self.outcomes, "path", limit).select("path", "fingerprint", F.lit(0).cast("long").alias("more"))
        n = self.outcomes.where(classify.is_unknown_pattern()).agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more")).where("more > 0")
        return some.unionByName(n.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("fingerprint"), F.col("more").cast("long").alias("more")))

    def totals(self) -> DataFrame:
        """(kind, state, n): targets and used material by verdict, ``error`` for what could not be read, and notes."""
        state = F.coalesce("verdict", F.lit("error"))
        count = lambda rows, kind: rows.groupBy(F.lit(kind).alias("kind"), state.alias("state")).agg(F.count("*").alias("n"))
        said = self.notes.groupBy(F.lit("note").alias("kind"), F.col("note").alias("state")).agg(F.count("*").alias("n"))
        return count(self.outcomes, "target").unionByName(count(self.used_materials(), "material")).unionByName(said)


def scan(files: DataFrame, *, ignore_hidden: bool = True, search_archives: bool = True, progress: Progress | None = None) -> Scan:
    """A scan of ``files`` (path, bucket, content, error), as ``discover.with_content`` gives them for the buckets targets and archives.

    A file that could not be read is an outcome with its error. Members of archives are judged in the task that reads their archive, one
    after the other (an archive is one value of 2 GB at most), so their bytes are neither written nor shuffled. Empty input gives empty results.
    """
    watch = lambda rows, stage, only=None, **more: progress.watch(rows, stage, only, **more) if progress else rows
    damaged = {"damaged": F.col("corrupted"), "unread": F.col("verdict").isNull()}
    judged = classify.diagnose(files.where("bucket = 'targets'").select("path", F.col("error").alias("_error"), "content"))
    outcomes = stored(watch(judged.withColumn("read_error", F.coalesce("_error", "read_error")).select("path", *FACTS), "targets", **damaged), "outcomes")
    mined = watch(mine_archives(files.where("bucket = 'archives' and error is null" if search_archives else "false")).withColumnRenamed("path", "archive"), "members")
    label = F.concat_ws("::", "archive", "member")
    hidden = F.coalesce(basename(F.col("member")).rlike(r"^(?:\.|~\$)"), F.lit(False))
    members = mined.select("archive", "member", label.alias("label"), hidden.alias("hidden"), "note", F.col("content").isNotNull().alias("there"), "content")
    held = stored(watch(classify.diagnose(members).select("archive", "member", "label", "hidden", "note", "there", *FACTS), "material", F.col("there"), **damaged), "materials")
    materials = held.where("there").select("archive", "member", "label", "hidden", *FACTS)
    unread = files.where("bucket = 'archives' and error is not null").select(F.col("path").alias("archive"), F.col("error").alias("note"))
    return Scan(outcomes, materials, held.where("note is not null").select("archive", "note").unionByName(unread), ignore_hidden)
