"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to ``spark.checkpoint.dir`` and read back, which cuts its lineage.

    A local session without that setting uses a temporary folder of this process.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="coexnet-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = f"file://{_own[app]}"
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
