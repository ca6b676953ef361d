"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder(str):
    """The path of a folder of tables. Their schemas are read once: a plan that names a table often would else open its files as often."""

    def __new__(cls, path: str) -> Folder:
        out = super().__new__(cls, path)
        out.schemas, out.rows = {}, {}
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, a file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schemas = getattr(sf_dir, "schemas", None)
    if schemas is None:
        return spark.read.parquet(path)
    if name not in schemas:
        schemas[name] = spark.read.parquet(path).schema
    return spark.read.schema(schemas[name]).parquet(path)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of rows of a table, which its files' footers tell; counted once for a ``Folder``."""
    rows = getattr(sf_dir, "rows", {})
    if name not in rows:
        rows[name] = table(spark, sf_dir, name).count()
    return rows[name]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only a session without one (a local test) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder, with their lineage cut. A lost executor costs no recomputation of what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later reads take only the columns they need, and a lost executor costs nothing."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/graphloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def held(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``stored``, for joins. A table of more rows is never broadcast: Spark takes a few columns of a wide, compressed file for small, and
    sends the driver many times what it expects."""
    out = stored(df)
    return out.hint("merge") if out.count() > rows else out


def merged(df: DataFrame, n: int, rows: int = 20_000) -> DataFrame:
    """A table of some n rows, for joins that a loop repeats: beyond ``rows`` never broadcast, as every round would send it through the driver."""
    return df.hint("merge") if n > rows else df


def few(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``cut``, for ids that are asked for: broadcast while they are few, so that what is joined with them isn't shuffled; else never."""
    kept = cut(df)
    return kept.hint("broadcast") if kept.count() <= rows else kept.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes a table that ``stored`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(df._graphloom_path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def components(edges: DataFrame, merge: bool = False) -> DataFrame:
    """``(node, root)`` for every node of the undirected edges ``(u, v)``; the root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each is a grouped minimum and a join, and the number of
    rounds grows with the logarithm of a component's diameter. Nothing is gathered in one place. merge: no round broadcasts its minima.
    """
    placed = lambda df: df.hint("merge") if merge else df
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(placed(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(placed(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen = tuple(mark)
