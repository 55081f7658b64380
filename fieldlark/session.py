"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "fieldlark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings this library is tested under.

    The skew-join rule is forced so that a hot key is split even where the split
    costs one more exchange; everything else is plain adaptive execution.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # long texts go to Python in smaller batches
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    The folder named by ``spark.checkpoint.dir`` (or already set on the context)
    is used as it is. Only a local session without one gets a temporary folder;
    on a cluster a machine-local folder would not be visible to the executors.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/fieldlark-{label}-{uuid.uuid4().hex}"


@contextmanager
def using(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs inside; those of before hold again behind it."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A fixed table from a few rows, held in the plan with its real size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(schema)
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(fields.types)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    Iterative operators call this once per round: the plan stays short, a lost
    executor re-reads files instead of replaying every earlier round, and the
    reader sees real file sizes, so join strategies stay size-checked.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
