"""Queries of the general training-data problems (2 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.timestamps import normalize_timestamps
from paperloom.operators.incremental import replay
from paperloom.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """file_id and instant of every mail whose sent_at denotes exactly one instant."""
    mails = table(spark, sf, "mails").select("file_id", "sent_at")
    return normalize_timestamps(mails, "sent_at").filter("utc_ms is not null").select("file_id", "utc_ms")


def p2_undetermined(spark: SparkSession, sf: str) -> DataFrame:
    """The mails left out of p2_found, with their notation: for review, nothing is dropped silently."""
    mails = table(spark, sf, "mails").select("file_id", "sent_at")
    return normalize_timestamps(mails, "sent_at").filter("utc_ms is null").select("file_id", "sent_at")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The new or changed files of each successful run."""
    return replay(table(spark, sf, "file_log"), table(spark, sf, "runs")).select(F.col("run_id").cast("long").alias("run_id"), "file_id")


QUERIES = {"p2_found": p2_found, "p2_undetermined": p2_undetermined, "p6_found": p6_found}
# Problem 6 in SQL: run by run, each file's newest row against what was last processed.
_RUNS = """with recursive good as (select run_id, started_at, row_number() over (order by started_at, run_id) as rn from runs where outcome = 'ok'),
newest as (select rn, run_id, file_id, arg_max({'sha': sha256, 'size': size, 'mtime': mtime, 'status': status, 'attempts': attempts}, (arrived_at, log_id)) as x from good join file_log on arrived_at <= started_at group by all),
step as (select 0::bigint as rn, file_id, null::varchar as sha, null::bigint as size, null::double as mtime, false as known, false as did, null::bigint as run_id from (select distinct file_id from file_log)
union all select rn + 1, file_id, case when did then x.sha else sha end, case when did then x.size else size end, case when did then x.mtime else mtime end, known or did, did, run_id from (select s.rn, s.file_id, s.sha, s.size, s.mtime, s.known, n.x, n.run_id, n.file_id is not null and coalesce(n.x.status not in ('missing', 'skipped'), true) and coalesce(n.x.attempts, 0) < 3 and (not s.known or not case when n.x.sha is not null and s.sha is not null then n.x.sha = s.sha else n.x.size is not distinct from s.size and n.x.mtime is not distinct from s.mtime end) as did from step s left join newest n on n.rn = s.rn + 1 and n.file_id = s.file_id where s.rn < (select max(rn) from good)))
select run_id, file_id from step where did"""

ORACLE: dict[str, str] = {"p6_found": _RUNS}
