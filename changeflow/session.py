"""Session setup, shared scratch folders and the size-checked small-side join."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A lookup side is broadcast up to this many rows and bytes.
SMALL_SIDE_ROWS = 20_000
SMALL_SIDE_BYTES = 32 << 20


def build_session(app: str = "changeflow", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session; a cluster deployment sets the master itself."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for a context, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_changeflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                info = zipfile.ZipInfo(os.path.relpath(path, os.path.dirname(root)))
                archive.writestr(info, open(path, "rb").read())
    tag = hashlib.sha256(packed.getvalue()).hexdigest()[:12]
    target = os.path.join(tempfile.mkdtemp(prefix="changeflow-code-"), f"changeflow-{tag}.zip")
    with open(target, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(target)
    context._changeflow_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is reachable from every executor. Only a
    local-mode session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="changeflow-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/changeflow/{name}-{uuid.uuid4().hex[:12]}"


def is_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES) -> bool:
    """True when the frame has at most ``max_rows`` rows and ``max_bytes`` as text; reads one row more at most."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    found = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), size.alias("bytes")).first()
    return found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", max_rows: int = SMALL_SIDE_ROWS,
) -> DataFrame:
    """Join a large side with a lookup side whose keys may be few and hot.

    The lookup is broadcast once its rows and bytes are known to fit. Beyond that it is an ordinary join of both sides,
    whose hot partitions of facts the adaptive skew join splits at run time. Both ways give the same rows.
    """
    if is_small(lookup, max_rows):
        return facts.join(F.broadcast(lookup), on, how)
    return facts.join(lookup, on, how)


def same_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", nulls: bool = True) -> DataFrame:
    """Join on columns of the same name, where null meets null as in a grouping; each column is there once.

    A frame that is joined with its own aggregate needs this, or its null groups are lost. ``nulls=False`` is a plain
    join, for keys known to be whole: it can use an existing bucketing.
    """
    if not nulls:
        return left.join(right, on, how)
    own = {c: f"_same_{i}" for i, c in enumerate(on)}
    condition = F.lit(True)
    renamed = right.withColumnsRenamed(own)
    for c, name in own.items():
        condition = condition & F.col(c).eqNullSafe(F.col(name))
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    keys = [F.coalesce(F.col(c), F.col(name)).alias(c) for c, name in own.items()]
    return joined.select(*keys, *[c for c in joined.columns if c not in on and c not in own.values()])


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark, "lineage"))
    return df.checkpoint()


def committed_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching ``pattern`` that carry Spark's success mark; one without it is unfinished."""
    context = spark.sparkContext
    marks = context._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = marks.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(f.getPath().getParent().toString() for f in (found or []))
