"""Audit rows, one per stage execution."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

log = logging.getLogger(__name__)

AUDIT_COLUMNS = {
    "execution_id": "string", "function_name": "string", "lottery_type": "string",
    "stage": "string", "status": "string", "message": "string", "gcs_bucket": "string",
    "gcs_object": "string", "draw_no": "bigint", "run_id": "string", "error_type": "string",
    "error_detail": "string", "executed_at": "timestamp", "executed_date": "date",
    "created_at": "timestamp",
}


def audit_rows(rows: DataFrame) -> DataFrame:
    """Complete partial audit rows: absent columns are NULL, stage defaults to the
    function name, dates derive from ``executed_at``."""
    full = rows.withColumns(
        {c: F.lit(None).cast(t) for c, t in AUDIT_COLUMNS.items() if c not in rows.columns}
    )
    return full.withColumns(
        {
            "stage": F.coalesce("stage", "function_name"),
            "executed_date": F.to_date("executed_at"),
            "created_at": F.coalesce("created_at", "executed_at"),
        }
    ).select(*[F.col(c).cast(t) for c, t in AUDIT_COLUMNS.items()])


# Readers that look for one execution skip row groups by these filters; small groups make that sharp.
LOOKUP = {
    "parquet.bloom.filter.enabled#execution_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.block.size": str(8 << 20),
}


def append_audit(rows: DataFrame, path: str) -> None:
    """Append; a failing audit write is logged and never breaks the job.

    Rows of an execution lie together: files are ordered by a hash of the id within a day.
    """
    try:
        placed = audit_rows(rows).sortWithinPartitions("executed_date", F.xxhash64("execution_id"), "execution_id")
        placed.write.mode("append").options(**LOOKUP).partitionBy("executed_date").parquet(path)
    except Exception as error:  # the audited work has succeeded or failed on its own
        log.error("audit write failed: %s", error)


def trace(audit: DataFrame, execution_id: str, *, since: str | None = None) -> DataFrame:
    """All stages of one execution in time order; with ``since`` only days from that ISO date on are looked at.

    The id is compared as it is stored, so the filter reaches the Bloom filters of the files.
    """
    found = audit.filter(F.col("execution_id") == execution_id)
    if since:
        found = found.filter(F.col("executed_date") >= F.to_date(F.lit(since)))
    return found.orderBy("created_at")
