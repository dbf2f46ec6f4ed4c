"""Bucketed Parquet tables below a folder, readable by any session without a metastore."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Names under which this session knows a folder: (application, path) -> table.
_NAMES: dict[tuple[str, str], str] = {}


_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """Inside, joins by a bucketed table's keys and others read the table where it lies, if the other side is
    dealt by its keys; of itself Spark exchanges both sides by all keys of the join. For what is run inside."""
    before = spark.conf.get(_ALL_KEYS, None)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.unset(_ALL_KEYS) if before is None else spark.conf.set(_ALL_KEYS, before)


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, order: Sequence[str] = ()) -> None:
    """Write ``df`` in buckets of ``keys``. Deal it by ``df.repartition(buckets, *keys)`` first (or read
    it from buckets of the same keys), so that each bucket is one file."""
    name = f"docframe_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").bucketBy(buckets, *keys).sortBy(*(order or keys)).option("path", path)
    writer.saveAsTable(name)
    _NAMES[df.sparkSession.sparkContext.applicationId, path] = name


def open_bucketed(spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The table at ``path``, known to Spark as bucketed: joins and groupings by ``keys`` read it in place."""
    key = spark.sparkContext.applicationId, path
    if key not in _NAMES:
        name = f"docframe_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({_names(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        _NAMES[key] = name
    return spark.table(_NAMES[key])
