"""Tables that several results read, written once to shared storage."""

import uuid

from pyspark.sql import DataFrame


def staging_dir(spark) -> str | None:
    """The shared folder named by the session, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back; unchanged where no folder is set."""
    root = staging_dir(df.sparkSession)
    if root is None:
        return df
    target = f"{root}/siftmoor-{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)
