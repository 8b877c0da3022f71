"""Tables that several later steps read, computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in ``spark.checkpoint.dir``, with its lineage cut.

    The files stay until that folder is cleared. Local masters without that setting get a folder of their own; other
    masters share no local folders, so there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="settled-"))
    return df.checkpoint()
