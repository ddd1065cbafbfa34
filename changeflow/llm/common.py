"""What the text operators share: Arrow batches of whole texts, word splitting, and stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeflow.session import shared_dir, ship_package

# Texts may be long, so a batch has few of them.
BATCH_ROWS = 1000

# Lower-cases A-Z; every other byte outside 0-9, a-z and non-ASCII becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
CONTINUATION = bytes(range(0x80, 0xC0))


def letter_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and all non-ASCII characters, with A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUATION))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def prepared(df: DataFrame) -> DataFrame:
    """Ship the package to the executors and keep Arrow batches small."""
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def append_columns(
    df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[list]], drop: list[str] = ()
) -> DataFrame:
    """Add the columns that ``make`` computes for each batch; one output row for each input row, no shuffle.

    An input column that has the name of a new one is replaced.
    """
    names = {f.name for f in fields} | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)
    kinds = [_arrow(f.dataType) for f in fields]
    out = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(v, k) for v, k in zip(make(batch), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + new, names=out)

    return prepared(df).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(),
    }[kind.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    plain = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
             "string": T.StringType(), "binary": T.BinaryType()}
    if kind.startswith("array "):
        return T.StructField(name, T.ArrayType(plain[kind.split()[1]]))
    return T.StructField(name, plain[kind])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no more than a reread."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
