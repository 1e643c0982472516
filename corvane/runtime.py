"""Session helpers: where intermediate tables go, how tables are read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def session(app: str = "corvane", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset (local tests) an own one is made."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; release() removes what lies there."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of this application, once no frame that reads them is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def materialize(df: DataFrame, tag: str = "part", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that survives the loss of executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: re-delivered rows repeat a key with the same content, so any of them will do."""
    return df.dropDuplicates(list(keys))


def uniform_label(column) -> F.Column:
    """A label in lower case, without outer blanks, with one underscore for each run of blanks or hyphens; null stays null."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
