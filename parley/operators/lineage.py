"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names and all executors share; only a session on one machine may name none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="parley-"))
    return df.checkpoint(eager=True)
