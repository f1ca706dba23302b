"""What the corpus operators share: column picking, scratch tables, batches, labels."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, and make this package importable on executors.

    When the repository is neither the working folder nor on PYTHONPATH (so that workers could not import it), a zip of
    the package goes out through Spark's own file server, as ``--py-files`` would send it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    on_path = {os.path.abspath(p or ".") for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]}
    # A folder of links to the repository counts too: the package is then found below it.
    if any(os.path.exists(os.path.join(p, "pavewise", "llm", "common.py")) for p in on_path):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        import zipfile

        target = Path(tempfile.mkdtemp(prefix="pavewise-")) / "pavewise.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in (Path(REPO) / "pavewise").rglob("*.py"):
                z.write(p, p.relative_to(REPO))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset a new local one, in local mode alone.

    On a cluster each executor would write to a disk of its own, so there an unset folder is an error.
    """
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return os.path.dirname(jsc.getCheckpointDir().get().rstrip("/"))
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="pavewise-checkpoint-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one run's table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, **named: str) -> DataFrame:
    """Exactly the named columns under new names, found by exact spelling and position.

    Extra columns, also those whose names differ only by case or repeat, never make a reference ambiguous. The first
    column of that spelling is taken.
    """
    at = {new: df.columns.index(old) for new, old in named.items()}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(new) for new, i in at.items()])


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null text as the empty text."""
    return pick(df, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def partitions(df: DataFrame) -> int:
    """A partition count that grows with the input: the scan's splits, or the session's shuffle setting if larger."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(col: Column, k: int) -> Column:
    """crc32 of the value's text, modulo k."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(k)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs of bytes that are neither space nor TAB..CR; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


