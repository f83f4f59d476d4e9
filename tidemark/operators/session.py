"""What several operators need of the session: a cut in the lineage, and how full the fullest key is."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a single task may sort or walk through; fuller keys are dealt to stretches first, with the same result.
ONE_TASK = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary
    folder that goes with the process; on a cluster that is an error."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
    return df.checkpoint(eager=True)


def fullest(rows: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
