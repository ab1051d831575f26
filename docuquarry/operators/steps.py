"""Steps of loops: results that are written, so that what follows neither repeats nor carries the plan behind them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed in the folder that spark.checkpoint.dir names; in a local session without one, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not getattr(context, "_steps_dir", None):
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context._steps_dir = tempfile.mkdtemp(prefix="steps-")
        context.setCheckpointDir("file://" + context._steps_dir)
    return df.checkpoint()
