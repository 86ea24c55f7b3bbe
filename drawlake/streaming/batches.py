"""Folders of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out before they are worked on: a batch of a few files is read by as many tasks, and
    decoding or sorting its rows costs far more than their way through a shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def batch_folder(root: str, batch_id: int) -> str:
    """Own folder of a batch: written with overwrite, a repeated batch replaces itself."""
    return f"{root}/batch_id={batch_id}"
