"""Tables kept as files by day: a recompute rewrites the days that it covers and no other file.

``DayTable`` is a folder of Parquet files, laid out by partition columns (for daily metrics ``bucket``, then
``grouping_id``, so that a view of one grain reads that grain's files only). ``replace`` puts new rows in the place of
all rows of the same scope (a monitor's day): rows that the new ones no longer support are pruned because they are
not written again. ``upsert`` puts them in the place of rows of the same key. Either way the touched days' old rows are
read, joined with the new ones (nulls are equal) and written with dynamic partition overwrite; partitions that hold no
row any more are deleted.

A change is first written whole to a folder beside the data (its name starts with an underscore, so no reader
lists it). If the job dies between there and the end, the next ``replace``, ``upsert`` or ``recover`` finishes it from
those files; a change that was not written whole is dropped. Running a change twice gives the same table. One
writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import rollup
from tidemark.operators.discovery import stored

_PENDING = "_pending"


class DayTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, by: tuple[str, ...] = ("bucket",)):
        self.spark, self.path, self.schema, self.by = spark, path.rstrip("/"), schema, by
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def read(self) -> DataFrame:
        """All rows; partition columns are pruned by filters. A table never written is empty."""
        if not self._fs.exists(self._at()) or not any(f.getPath().getName().startswith(f"{self.by[0]}=") for f in self._fs.listStatus(self._at())):
            return self.spark.createDataFrame([], self.schema)
        ordered = [f for f in self.schema if f.name not in self.by] + [self.schema[c] for c in self.by]
        return self.spark.read.schema(StructType(ordered)).parquet(self.path).select(self.schema.names)

    def replace(self, new: DataFrame, scope: DataFrame) -> list:
        """The rows of ``new`` instead of all that match a row of ``scope`` (whose columns include the first partition column)."""
        return self._change(new, scope, scope.columns)

    def upsert(self, new: DataFrame, keys: list[str]) -> list:
        """The rows of ``new`` instead of those of the same keys; other rows stay."""
        return self._change(new, None, keys)

    def _change(self, new: DataFrame, gone: DataFrame | None, keys: list[str]) -> list:
        self.recover()
        day, change = self.by[0], uuid.uuid4().hex
        # the new rows are computed once; what they touch and what is written are read from there
        new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{_PENDING}/{change}/new")
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/{_PENDING}/{change}/new")
        gone = new.select(*keys) if gone is None else gone
        touched = sorted((r[0] for r in gone.select(day).union(new.select(day)).distinct().collect()), key=lambda x: (x is not None, x))  # a value for each day touched
        if not touched:
            self._fs.delete(self._at(_PENDING, change), True)
            return []
        some = F.col(day).isin([x for x in touched if x is not None])
        old = self.read().where(some | F.col(day).isNull() if None in touched else some)
        kept = rollup.without(old, gone.select(*keys).distinct(), keys)
        merged = kept.unionByName(new)
        rows = f"{self.path}/{_PENDING}/{change}/rows"
        merged.hint("rebalance", *self.by).write.parquet(rows)
        days = self.spark.createDataFrame([(json.dumps([str(x) if x is not None else None for x in touched]),)], "days string")
        days.coalesce(1).write.text(f"{self.path}/{_PENDING}/{change}/days")  # its _SUCCESS says that the change is whole
        self._apply(change)
        return touched

    def recover(self) -> None:
        """Finish a change that was written whole, drop one that was not."""
        if self._fs.exists(self._at(_PENDING)):
            for f in self._fs.listStatus(self._at(_PENDING)):
                change = f.getPath().getName()
                if self._fs.exists(self._at(_PENDING, change, "days", "_SUCCESS")):
                    self._apply(change)
                else:
                    self._fs.delete(f.getPath(), True)

    def _apply(self, change: str) -> None:
        at = f"{self.path}/{_PENDING}/{change}"
        touched = json.loads(self.spark.read.text(f"{at}/days").first()[0])
        rows = self.spark.read.schema(self.schema).parquet(f"{at}/rows")
        rows.hint("rebalance", *self.by).sortWithinPartitions(*self.by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*self.by).parquet(self.path)
        held = {self._folder(r) for r in rows.select(*self.by).distinct().collect()}  # a row for each partition touched
        for day in touched:
            self._drop_others(self._folder((day,)), 1, held)
        self._fs.delete(self._at(_PENDING, change), True)

    def _folder(self, values) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{c}={escape(str(v)) if v is not None else '__HIVE_DEFAULT_PARTITION__'}" for c, v in zip(self.by, values, strict=False))

    def _drop_others(self, folder: str, depth: int, held: set[str]) -> None:
        """Delete what a touched day holds besides the partitions just written."""
        if not self._fs.exists(self._at(folder)):
            return
        if not any(h == folder or h.startswith(f"{folder}/") for h in held):
            self._fs.delete(self._at(folder), True)
        elif depth < len(self.by):
            for f in self._fs.listStatus(self._at(folder)):
                self._drop_others(f"{folder}/{f.getPath().getName()}", depth + 1, held)

    def files(self) -> set[str]:
        """Names of the data files, below the table's folder."""
        found, todo = set(), [self._at()] if self._fs.exists(self._at()) else []
        while todo:
            for f in self._fs.listStatus(todo.pop()):
                name = f.getPath().getName()
                if f.isDirectory() and not name.startswith("_"):
                    todo.append(f.getPath())
                elif name.endswith(".parquet"):
                    found.add(f.getPath().toString().split(self.path.split(":")[-1] + "/", 1)[-1])
        return found


#: Daily metrics lie by day and grain.
METRICS_BY = ("bucket", "grouping_id")
SCOPE = ["monitor_id", "bucket"]


def daily_metrics(spark: SparkSession, path: str, like: DataFrame) -> DayTable:
    """The written rollup; ``like`` has its columns, and ``reason`` says why a day was last computed."""
    schema = StructType([f for f in like.schema if f.name != "reason"]).add("reason", "string")
    return DayTable(spark, path, schema, METRICS_BY)


def roll_up(table: DayTable, docs: DataFrame, ledger: DataFrame, days: DataFrame, reason: str = "daily") -> tuple[list, dict]:
    """Compute and write the days (monitor_id, bucket); (days written, error of each day that failed).

    All days are one job. Where that fails, halves of them are tried, so that a day that can't be computed is left as
    it was and stops no other.
    """
    days = stored(days.select(*SCOPE).distinct())
    wanted = sorted(r[0] for r in days.select("bucket").distinct().collect())

    def some(part: list) -> tuple[list, dict]:
        scope = days.where(F.col("bucket").isin(part))
        keep = lambda df: df.join(scope, SCOPE, "left_semi")
        try:
            new = rollup.daily_rollup(keep(docs), stored(keep(ledger))).withColumn("reason", F.lit(reason))
            return table.replace(new, scope), {}
        except Exception as e:
            if len(part) == 1:
                return [], {part[0]: str(e).splitlines()[0]}
            done, failed = [], {}
            for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                d, f = some(half)
                done, failed = done + d, failed | f
            return done, failed

    return some(wanted) if wanted else ([], {})


def late_arrivals(table: DayTable, docs: DataFrame, ledger: DataFrame, late: DataFrame, reason: str = "late_arrival") -> tuple[list, dict]:
    """Rewrite only those local days that late (or otherwise changed) documents touch."""
    return roll_up(table, docs, ledger, late.select(*SCOPE).distinct(), reason)
