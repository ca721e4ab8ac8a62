"""Where intermediate tables are cut from their lineage: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a local master gets a folder of its own
    (tests); on a cluster that is an error, as executors would write where nobody else can read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="tilequarry-"))
    return found.rstrip("/")


_fallback: dict[str, str] = {}
FEW_FILES = 1 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there, and any executor can read it.

    Small results of many tasks are first put together to files of the session's advisory size (``rebalance``). Files
    stay until :func:`drop_written` or the folder's owner removes them: a lazily returned result may still read them.
    """
    path = fresh_path(df.sparkSession, name)
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written`, once nothing lazy reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def is_scan(df: DataFrame) -> bool:
    """Whether rows of ``df`` are rows of Parquet files, each at most once, chosen alike in every job."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.child()
    if node.getClass().getSimpleName() != "LogicalRelation" or node.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return node.relation().fileFormat().toString() == "Parquet"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` and a long column ``name``: the row's number in its table, the same in every job over the result.

    The number is made of the file's name and the row's place in it, so it does not depend on how a scan is split, on the
    number of cores or on executors that come and go between two jobs. Rows that are not plainly those of Parquet files
    (joined, limited, made in memory), or of more than ``FEW_FILES`` files, are written once and the written ones numbered.
    One row a file reaches the driver and is broadcast; the driver holds the list of files anyway.
    """
    spark = df.sparkSession
    if not is_scan(df):
        df = written(df, "rows", rebalance=False)
    path, at = f"{name}_path", f"{name}_at"
    for _ in range(2):
        meta = df.metadataColumn("_metadata")
        told = df.select(*[F.col(f"`{c}`") for c in df.columns], meta["file_path"].alias(path), meta["row_index"].alias(at))
        sizes = told.groupBy(path).agg(F.max(at).alias(at))
        files = sizes.limit(FEW_FILES + 1).collect()
        if len(files) <= FEW_FILES:
            break
        df = written(df, "rows")
    starts, total = [], 0
    for r in sorted(files):
        starts.append((r[0], total))
        total += r[1] + 1
    known = F.broadcast(spark.createDataFrame(starts, f"{path} string, {name} long"))
    return told.join(known, path).select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col(at)).alias(name))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Hand texts to Python at most ``rows`` at a time, as the default of 10000 is meant for short rows.

    This stays set on the session: the tables that operators return are computed later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
