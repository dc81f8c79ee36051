"""Round-trip folders under the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from maskloom.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/maskloom-{name}-{uuid.uuid4().hex}"
