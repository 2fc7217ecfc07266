"""Spreading costly work on few large rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting: how many pieces small inputs with costly rows are dealt over; unset: those of the scan.
SETTING = "spark.lectern.inputPartitions"


def dealt(df: DataFrame, pieces_per_core: int = 4) -> DataFrame:
    """Deal narrow rows from which each makes a costly one over all cores of the session.

    The scan alone would not do: a file of one row group is one task whatever its number of rows.  The
    number of pieces grows with the cluster, not with the rows; a piece is worked on row by row.
    """
    least = max(32, pieces_per_core * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(int(df.sparkSession.conf.get(SETTING, "0")) or least)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows over ``partitions``, else over as many as the session's setting says, before they are worked on.

    Only a user knows that an input is small and its rows are costly (a file of one row group is one
    task); nothing is counted here, and without either the scan's own pieces stay.
    """
    wanted = partitions or int(df.sparkSession.conf.get(SETTING, "0"))
    return df.repartition(wanted) if wanted else df
