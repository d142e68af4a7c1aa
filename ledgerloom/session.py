"""Session helpers: a tuned local session, and written tables that cut lineage.

Executors may be lost at any time, so an intermediate that is read more than once is written as Parquet into the folder
that the cluster shares (``spark.checkpoint.dir``), never kept as local blocks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[int, str] = {}


def local_session(cores: str = "8", app: str = "ledgerloom", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; on a cluster, the session comes from spark-submit."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error, as a folder of one
    machine can't be read by the others.
    """
    key = id(spark.sparkContext._jsc)
    if key not in _FOLDERS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="ledgerloom-")
        _FOLDERS[key] = f"{base.rstrip('/')}/loom-{uuid.uuid4().hex[:12]}"
        atexit.register(_drop, spark, _FOLDERS[key])
    return _FOLDERS[key]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


class Written:
    """A written table: ``df`` reads it back; ``drop()`` removes it once nothing reads it any more.

    ``counts``: conditions by name; how many rows meet each is in ``seen`` afterwards, counted while writing.
    """

    def __init__(self, df: DataFrame, name: str = "t", **counts: Column):
        self._spark = df.sparkSession
        self.path = f"{shared_folder(self._spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self.seen: dict[str, int] = {}
        watched, out = None, df
        if counts:
            watched = Observation()
            out = df.observe(watched, *[F.count_if(c).alias(n) for n, c in counts.items()])
        out.write.mode("overwrite").parquet(self.path)
        if watched is not None:
            self.seen = dict(watched.get)
        self.df = self._spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _drop(self._spark, self.path)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Written(df, name).df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: for few bytes that cost much Python time a row, which size-based partitions would put into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fan_out(scan: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt over all cores; other scans as they are.

    For steps that cost much time a byte. The files are counted by name, without a job; a large table has files enough and isn't
    shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if len(scan.inputFiles()) < cores else scan
