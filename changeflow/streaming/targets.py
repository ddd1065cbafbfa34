"""Keyed targets for ``foreachBatch``.

A batch is reduced to one row per key (or key and field) and written to a folder named after
its batch id, so a replayed batch overwrites itself. Reading folds base and batches by sequence,
which gives the same state in whatever order batches arrive, and however often one is read.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions.times import older_than
from changeflow.operators import apply
from changeflow.schemas import META_OP, META_SEQ, META_TS
from changeflow.session import committed_folders


class Target(ABC):
    """Where changes go: create, apply a batch, bulk load, count, read."""

    op_column, ts_column = META_OP, META_TS

    def __init__(self, spark: SparkSession, path: str, key_columns: list[str]):
        self.spark, self.path, self.key_columns = spark, path.rstrip("/"), key_columns

    @abstractmethod
    def reduce(self, changes: DataFrame) -> DataFrame:
        """A batch as the rows to store."""

    @abstractmethod
    def fold(self, stored: DataFrame) -> DataFrame:
        """Stored rows of many batches as one row per unit, deletes included."""

    @abstractmethod
    def read(self) -> DataFrame:
        """The live rows."""

    @property
    @abstractmethod
    def layout(self) -> T.StructType:
        """Columns of the stored rows."""

    def ensure(self) -> None:
        """Create the target unless it is there."""
        if self._generation() is None:
            self._write_base(self.spark.createDataFrame([], self.layout), f"{self.path}/gen=0/base")

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Store a batch; the same id twice leaves one copy."""
        self._write(self.reduce(changes), f"{self._home()}/batch={batch_id}")

    def load(self, rows: DataFrame, chunk_id: int, ts_ms: int = 0) -> None:
        """Bulk-load snapshot rows as inserts older than any change."""
        changes = rows.select(
            "*", F.lit("I").alias("op"), F.lit(ts_ms).cast("bigint").alias("ts_ms"),
            F.lit(0).cast("bigint").alias("seq"))
        self._write(self.reduce(changes), f"{self._home()}/chunk={chunk_id}")

    def count(self) -> int:
        return self.read().count()

    def stored(self, folders: str = "*") -> DataFrame:
        """Committed rows of the current generation."""
        paths = committed_folders(self.spark, f"{self._home()}/{folders}")
        reader = self.spark.read.schema(self.layout)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.layout)

    def state(self) -> DataFrame:
        """One row per unit, deletes included."""
        return self.fold(self.stored())

    def compact(self, drop_deletes_before: Column | None = None, retention: str = "1 HOUR") -> None:
        """Fold everything into the base of a new generation; run it between batches.

        Readers move over when the new base is complete. Deletes are kept as markers, since an
        older change could otherwise revive their key; given a time, markers older than
        ``retention`` before it are dropped.
        """
        folded = self.live_entries(self.state())
        if drop_deletes_before is not None:
            at = F.timestamp_millis(F.col(self.ts_column))
            old = older_than(at, drop_deletes_before, retention)
            folded = folded.where(~((F.col(self.op_column) == "D") & old))
        self._write_base(folded, f"{self.path}/gen={self._generation() + 1}/base")

    def live_entries(self, folded: DataFrame) -> DataFrame:
        """Folded rows without those that must not come back when a delete marker goes."""
        return folded

    def _write_base(self, rows: DataFrame, folder: str) -> None:
        self._write(rows, folder)

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(folder)

    def _generation(self) -> int | None:
        bases = committed_folders(self.spark, f"{self.path}/gen=*/base")
        return max((int(b.rsplit("gen=", 1)[-1].split("/")[0]) for b in bases), default=None)

    def _home(self) -> str:
        self.ensure()
        return f"{self.path}/gen={self._generation()}"


class ReplaceTarget(Target):
    """Rows as columns; a change replaces the whole row.

    With ``buckets`` the base is a bucketed table over its folder: reading and compacting then
    shuffle only what came after the base, however large the base is.
    """

    def __init__(self, spark: SparkSession, path: str, key_columns: list[str], columns: T.StructType,
                 order: str = "seq", buckets: int = 0):
        super().__init__(spark, path, key_columns)
        self.columns, self.order, self.buckets = columns, order, buckets

    @property
    def layout(self) -> T.StructType:
        meta = [T.StructField(META_OP, T.StringType()), T.StructField(META_TS, T.LongType()),
                T.StructField(META_SEQ, T.LongType())]
        return T.StructType([*self.columns.fields, *meta])

    def reduce(self, changes: DataFrame) -> DataFrame:
        latest = apply.with_meta(apply.latest_change(changes, self.key_columns, self.order))
        present = set(latest.columns)
        return latest.select(*[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.layout.fields])

    def fold(self, stored: DataFrame) -> DataFrame:
        rest = [f.name for f in self.layout.fields if f.name not in self.key_columns]
        best = F.max_by(F.struct(*rest), F.col(META_SEQ)).alias("_best")
        folded = stored.groupBy(*self.key_columns).agg(best).select(*self.key_columns, "_best.*")
        return folded.select(*[f.name for f in self.layout.fields])

    def read(self) -> DataFrame:
        return self.state().where(F.col(META_OP) != "D")

    def state(self) -> DataFrame:
        if not self.buckets:
            return super().state()
        base, later = self._base(), self.stored("*=*")
        # A join never matches keys with a missing part; those few rows are folded instead.
        whole = F.lit(True)
        for key in self.key_columns:
            whole = whole & F.col(key).isNotNull()
        changes = later.where(whole).withColumnsRenamed({META_OP: "op", META_TS: "ts_ms", META_SEQ: "seq"})
        merged = apply.merge_replace(base.where(whole), changes, self.key_columns, keep_deleted=True, null_keys=False)
        rest = self.fold(base.where(~whole).unionByName(later.where(~whole)))
        return merged.select(*rest.columns).unionByName(rest)

    def _table(self, folder: str) -> str:
        return "changeflow_" + hashlib.md5(folder.encode()).hexdigest()

    def _write_base(self, rows: DataFrame, folder: str) -> None:
        if not self.buckets:
            return super()._write_base(rows, folder)
        writer = rows.repartition(self.buckets, *self.key_columns).write.mode("overwrite").option("path", folder)
        writer = writer.bucketBy(self.buckets, *self.key_columns).sortBy(*self.key_columns)
        writer.format("parquet").saveAsTable(self._table(folder))

    def _base(self) -> DataFrame:
        """The base as a bucketed table; a new session has to be told about it."""
        folder = f"{self._home()}/base"
        name, keys = self._table(folder), ", ".join(f"`{k}`" for k in self.key_columns)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.layout.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{folder}'")
        return self.spark.table(name)


class PatchTarget(Target):
    """Documents as field entries; a change sets only the fields it carries."""

    op_column, ts_column = "op", "ts_ms"

    def __init__(self, spark: SparkSession, path: str, key_columns: list[str]):
        super().__init__(spark, path, key_columns)

    @property
    def layout(self) -> T.StructType:
        text, number = T.StringType(), T.LongType()
        fields = [T.StructField(k, text) for k in [*self.key_columns, "field", "value"]]
        return T.StructType([*fields, T.StructField("seq", number), T.StructField("ts_ms", number),
                             T.StructField("op", text)])

    def reduce(self, changes: DataFrame) -> DataFrame:
        return apply.fold_entries(apply.patch_entries(changes, self.key_columns), self.key_columns)

    def fold(self, stored: DataFrame) -> DataFrame:
        return apply.fold_entries(stored, self.key_columns)

    def live_entries(self, folded: DataFrame) -> DataFrame:
        return apply.without_hidden(folded, self.key_columns)

    def read(self) -> DataFrame:
        return apply.documents_from_entries(self.state(), self.key_columns)


_TARGETS: dict[str, Callable[..., Target]] = {"replace": ReplaceTarget, "patch": PatchTarget}


def register_target(name: str, factory: Callable[..., Target]) -> None:
    """Add a kind of target."""
    _TARGETS[name] = factory


def create_target(kind: str, *args, **kwargs) -> Target:
    if kind not in _TARGETS:
        raise ValueError(f"unknown target kind {kind!r}")
    return _TARGETS[kind](*args, **kwargs)
