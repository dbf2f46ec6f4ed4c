"""Tables of documents that change batch by batch and are read as one version.

A batch appends its own rows below ``data/<table>/batch=<id>`` and the papers it renews
below ``renewed/batch=<id>``; nothing stored earlier is touched. One small file then
names the batches that count, for all tables at once: a reader takes the newest such file
and sees either none or all of a batch. Of a paper it sees the rows of the last batch
that renewed it, in every table. ``compact`` writes the rows that still count as one
batch, so that reads do not follow history. Batch ids grow; a batch that comes again
changes nothing. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Version:
    """``batches`` count, in order of rank; stream batches up to ``last`` have been taken."""

    number: int = 0
    last: int = -1
    batches: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()


@dataclass(frozen=True)
class DocumentStore:
    root: str
    spark: SparkSession

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an earlier one by its number."""
        try:
            found = self.spark.read.text(f"{self.root}/versions/*")
        except AnalysisException as exc:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return Version()
        ranked = found.select(F.get_json_object("value", "$.number").cast("int").alias("number"), "value")
        row = ranked.where("true" if number is None else f"number = {number}").orderBy(F.desc("number")).first()
        if row is None:
            if number is None:
                return Version()
            raise ValueError(f"no version {number}")
        got = json.loads(row.value)
        return Version(got["number"], got["last"], tuple(got["batches"]), tuple(got["tables"]))

    def _switch(self, version: Version) -> None:
        """One file makes the version count; it appears under its name when it is complete."""
        rows = [(json.dumps(vars(version) | {"batches": list(version.batches), "tables": list(version.tables)}),)]
        self.spark.createDataFrame(rows, "value string").coalesce(1).write.text(f"{self.root}/versions/{version.number:09d}")

    def commit(self, batch_id: int, papers: DataFrame, tables: dict[str, DataFrame]) -> bool:
        """Replace ``papers`` (paper_id) by the rows of ``tables`` (each with paper_id); False if
        the batch has been taken before. What a failed attempt left is written over."""
        now = self.version()
        if batch_id <= now.last:
            return False
        name = f"{batch_id:09d}"
        papers.select("paper_id").distinct().write.mode("overwrite").parquet(f"{self.root}/renewed/batch={name}")
        for table, rows in tables.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/data/{table}/batch={name}")
        self._switch(Version(now.number + 1, batch_id, (*now.batches, name), tuple(sorted({*now.tables, *tables}))))
        return True

    def _paths(self, folder: str, version: Version) -> DataFrame | None:
        base = f"{self.root}/{folder}"
        parts = []
        for rank, name in enumerate(version.batches):
            try:
                parts.append(self.spark.read.parquet(f"{base}/batch={name}").withColumn("__rank", F.lit(rank)))
            except AnalysisException as exc:  # a batch need not hold every table
                if "PATH_NOT_FOUND" not in str(exc):
                    raise
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """Rows of a table in the newest version, or in an earlier one."""
        version = self.version(number)
        rows = self._paths(f"data/{table}", version) if table in version.tables else None
        if rows is None:
            raise ValueError(f"no table {table} in version {version.number}")
        if len(version.batches) == 1:
            return rows.drop("__rank")
        owner = self._paths("renewed", version).groupBy("paper_id").agg(F.max("__rank").alias("__rank"))
        return rows.join(owner, ["paper_id", "__rank"], "left_semi").drop("__rank")

    def compact(self) -> None:
        """Write the rows that count as one batch. Older versions stay readable."""
        now = self.version()
        if len(now.batches) < 2:
            return
        name = f"base-{now.number + 1:09d}"
        self._paths("renewed", now).select("paper_id").distinct().write.mode("overwrite").parquet(f"{self.root}/renewed/batch={name}")
        for table in now.tables:
            self.read(table).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/data/{table}/batch={name}")
        self._switch(Version(now.number + 1, now.last, (name,), now.tables))


def committed(store: DocumentStore, build: Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]], every: int = 20):
    """Function for ``foreachBatch``: ``build`` gives a batch's papers and tables; the store is
    compacted after ``every`` batches."""

    def take(batch: DataFrame, batch_id: int) -> None:
        if batch_id > store.version().last:
            papers, tables = build(batch)
            store.commit(batch_id, papers, tables)
        if len(store.version().batches) > every:
            store.compact()

    return take
