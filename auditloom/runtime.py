"""Session settings, lineage cuts and size checks shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast by this library only below this many rows and bytes of texts and lists, counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("auditloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only if that is unset."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="auditloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files.

    The files outlive any executor, so later reads never recompute what came before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed columns below the shared checkpoint folder, and read from there.

    Like ``cut_lineage``, for wide rows of which later passes read a few columns each.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/auditloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._auditloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    path = getattr(df, "_auditloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def held_keys(keys: DataFrame, rows: int = BROADCAST_ROWS) -> np.ndarray | None:
    """The sorted values of a BIGINT column if it has at most ``rows``, counted first; else None."""
    if not small_enough(keys, rows):
        return None
    return np.sort(keys.toArrow().column(0).to_numpy())


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, found without counting beyond them."""
    return df.limit(rows + 1).count() <= rows


def _width(name: str, kind: str) -> Column | None:
    c = F.col(f"`{name}`")
    if kind in ("string", "binary"):
        return F.octet_length(c)
    if kind.startswith("array"):
        return F.size(c) * 8 if kind in ("array<bigint>", "array<int>", "array<double>") else F.octet_length(F.to_json(c))
    return F.octet_length(F.to_json(c)) if kind.startswith(("map", "struct")) else None


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small in rows and bytes, else unchanged (a shuffled join follows)."""
    widths = [F.sum(F.coalesce(w, F.lit(0)).cast("long")) for n, t in df.dtypes if (w := _width(n, t)) is not None]
    if not widths:
        return F.broadcast(df) if small_enough(df, rows) else df
    count, *sizes = df.limit(rows + 1).agg(F.count("*"), *widths).first()
    return F.broadcast(df) if count <= rows and sum(x or 0 for x in sizes) <= bytes_ else df


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, share: float = 0.001, least: int = 10_000) -> DataFrame:
    """``rows`` joined to ``per_key``, which has one row a key, with no key's rows gathered in one task.

    Keys with more than ``share`` of all rows (at most 1 / ``share`` of them) meet by broadcast where their rows
    lie; only the others are moved.
    """
    counts = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least))
    total = rows.count() if counts.limit(1).count() else 0
    heavy = F.broadcast(counts.where(F.col("_n") > total * share).select(key))
    hot = F.broadcast(per_key.join(heavy, key, "left_semi"))
    rest = rows.join(heavy, key, "left_anti").join(per_key, key)
    return rows.join(hot, key).unionByName(rest)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` over enough tasks for Python work, if its scan makes fewer.

    After an exchange the engine itself makes at least as many tasks as there are cores wherever the rows
    are worth it, so such a plan stays as it is: rows are never moved twice.
    """
    spark = df.sparkSession
    least = least or spark.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(least) if max(1, df.rdd.getNumPartitions()) < least else df
