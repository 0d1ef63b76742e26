"""Shared folder, staged tables and connected components for the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of an application that has no spark.checkpoint.dir.
_OWN: dict[str, str] = {}
#: Folder of each staged table that is still in use.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the folder of a staged table that no later step reads."""
    if (name := _FOLDERS.pop(df, None)) is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def partitions_for(spark: SparkSession, rows: int, per: int) -> int:
    """Enough partitions for so many rows each, and never fewer than the session's default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per), 1)


def hash_sample(df: DataFrame, rows: int, total: int, *by: str) -> DataFrame:
    """The `rows` rows of least hash. Of a large table only a share about half again as large is sorted, so that what
    tasks hand over does not grow with their number."""
    h = F.xxhash64(*by)
    share = int((1 << 30) * min(1.0, (1.5 * rows + 50) / max(1, total)))
    return df.where(F.pmod(h, F.lit(1 << 30)) < share).orderBy(F.pmod(h, F.lit(1 << 30)), *by).limit(rows)


def columns_of(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, by position, so that extra columns whose names clash in letter case do no harm."""
    names = df.columns
    missing = [n for n in needed if n not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len({n.lower() for n in names}) == len(names):
        return df.select(*needed)
    plain = df.toDF(*(f"_{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"_{names.index(n)}").alias(n) for n in needed))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns renamed c0, c1, ... by place, and the new name of each; restore with toDF(*df.columns)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


#: Rows of a staged table that may be broadcast, at about 100 bytes each.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, of: DataFrame | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast where it (or `of`, which bounds it) has so few rows by count, else as it is, to be shuffled."""
    return F.broadcast(df) if (df if of is None else of).count() <= most else df


#: No more keys than this can each hold over a HOT_SHARE-th of the rows, so their table may be broadcast.
HOT_SHARE, SALTS = 1_000, 64


def hot_keys(counts: DataFrame, keys: list[str], n: str, rows: int) -> DataFrame:
    """Of counts (keys, n), one row a key, the keys that hold over a HOT_SHARE-th of so many rows."""
    return counts.where(F.col(n) * HOT_SHARE > rows).select(*keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how), inner, left, left_semi or left_anti, where the rows of left with a hot key (see
    hot_keys()) are dealt over SALTS tasks by a hash of the whole row and the few rows of right with that key go to each."""
    flag = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    whole = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
    left = left.join(flag, keys, "left").withColumn("_salt", F.when(F.col("_hot"), whole).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(flag, keys, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """Connected components of an edge table of longs: (node, component), component the smallest node reachable.

    Randomised contraction: in each round every node joins the neighbour (or itself) with the least hash of that
    round, edges are renamed to the chosen nodes, and loops and repeats go. Expected rounds are logarithmic in the
    longest path. Minima are pre-aggregated before they are shuffled, so a hub costs no more than another node.
    """
    spark = edges.sparkSession
    left = staged(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges"
    )
    chosen: list[DataFrame] = []
    for r in range(rounds):
        if left.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        ends = left.select(F.col("a").alias("node"), rank("b").alias("to")).unionAll(
            left.select(F.col("b").alias("node"), rank("a").alias("to"))
        )
        pick = ends.groupBy("node").agg(F.min("to").alias("to"))
        pick = staged(pick.select("node", F.least("to", rank("node"))["node"].alias("to")), f"picks{r}")
        chosen.append(pick)
        after = (
            left.join(pick.toDF("a", "ta"), "a")
            .join(pick.toDF("b", "tb"), "b")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .where("a < b")
            .distinct()
        )
        after = staged(after, f"edges{r}")
        dropped(spark, left)
        release(spark)
        left = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    dropped(spark, left)
    if not chosen:
        return spark.createDataFrame([], "node long, component long")
    label = chosen[-1]
    for pick in reversed(chosen[:-1]):
        label = (
            pick.join(label.toDF("to", "root"), "to", "left").select("node", F.coalesce("root", "to").alias("to"))
        )
    label = staged(label, "roots")
    least = label.groupBy("to").agg(F.min("node").alias("component"))
    out = staged(label.join(least, "to").select("node", "component"), "components")
    for old in (*chosen, label):
        dropped(spark, old)
    release(spark)
    return out
