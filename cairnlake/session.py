"""Session factory, shared-folder handling and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairnlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and there is but one machine."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cairnlake-")
    spark.sparkContext.setCheckpointDir(made)
    return made


_made: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables that durable() wrote so far; call it once no result that came from them is needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives a lost executor and,
    unlike checkpoint(), lets later reads prune columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.mode("overwrite").parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if getattr(context, "_cairnlake", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cairnlake-"), "cairnlake_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    context._cairnlake = True
