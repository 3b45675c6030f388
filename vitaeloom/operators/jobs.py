"""The job table: latest rows, nested payloads and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "resume struct<basics:struct<name:string,email:string,phone:string,location:string>,"
    "work:array<struct<company:string,position:string,start_date:string,end_date:string,bullets:array<struct<raw_text:string,matched_clusters:array<string>>>>>,"
    "education:array<struct<institution:string,degree:string,dates:string>>,skills:array<struct<raw_text:string,matched_clusters:array<string>>>,"
    "projects:array<struct<name:string,description:string,bullets:array<struct<raw_text:string,matched_clusters:array<string>>>>>,raw_text:string>,"
    "report struct<checks:array<struct<check_name:string,status:string>>>,"
    "jd struct<role_track_signal:string,seniority_signal:string,years_experience:int,requirements:array<struct<raw_text:string,requirement_type:string,matched_clusters:array<string>>>,raw_text:string>,"
    "result struct<overall:int,components:struct<semantic:int,taxonomy:int,parseability:int>>"
)


def current_jobs(jobs: DataFrame) -> DataFrame:
    """One row per id, the latest by updated_at; replayed rows fall away."""
    best = F.max_by(F.struct(*[c for c in jobs.columns if c != "id"]), F.struct("updated_at", "created_at", "status"))
    return jobs.where("id is not null").groupBy("id").agg(best.alias("_row")).select("id", "_row.*")


def unpack_inputs(jobs: DataFrame) -> DataFrame:
    """Adds the decoded `inputs`; null where the text is no such JSON."""
    return jobs.withColumn("inputs", F.from_json("input_json", PAYLOAD))


def job_requirements(unpacked: DataFrame) -> DataFrame:
    """(id, req_idx, raw_text, requirement_type, clusters) of every job."""
    return unpacked.select("id", F.posexplode("inputs.jd.requirements").alias("req_idx", "r")).select("id", "req_idx", "r.raw_text", "r.requirement_type", F.coalesce("r.matched_clusters", F.array().cast("array<string>")).alias("clusters"))


def job_lines(unpacked: DataFrame) -> DataFrame:
    """(id, source, entry_idx, line_no, raw_text, clusters): bullets of work and projects, and skills."""
    def side(column: str, source: str) -> DataFrame:
        entries = unpacked.select("id", F.posexplode(column).alias("entry_idx", "e"))
        return entries.select("id", F.lit(source).alias("source"), "entry_idx", F.posexplode("e.bullets").alias("line_no", "b")).select("id", "source", "entry_idx", "line_no", "b.raw_text", F.col("b.matched_clusters").alias("clusters"))

    skills = unpacked.select("id", F.lit("skill").alias("source"), F.lit(None).cast("int").alias("entry_idx"), F.posexplode("inputs.resume.skills").alias("line_no", "b"))
    rows = side("inputs.resume.work", "work").unionByName(side("inputs.resume.projects", "project")).unionByName(skills.select("id", "source", "entry_idx", "line_no", "b.raw_text", F.col("b.matched_clusters").alias("clusters")))
    return rows.withColumn("clusters", F.coalesce("clusters", F.array().cast("array<string>")))


def expired(now: Column, status: Column | None = None, updated: Column | None = None, finished_days: int = 30, unpaid_days: int = 7) -> Column:
    """Is a row past its retention? Finished rows after 30 days, unpaid ones after 7, strictly; others never."""
    status = F.col("status") if status is None else status
    updated = F.col("updated_at") if updated is None else updated
    age = lambda days: updated < now - F.expr(f"interval {days} days")
    return F.coalesce((status.isin("done", "failed") & age(finished_days)) | ((status == "awaiting_payment") & age(unpaid_days)), F.lit(False))


def purge(jobs: DataFrame, now: Column, dry_run: bool = False) -> DataFrame:
    """The rows to keep; as a dry run, the number of rows to delete by status."""
    gone = expired(now)
    return jobs.where(gone).groupBy("status").agg(F.count("*").alias("rows")) if dry_run else jobs.where(~gone)
