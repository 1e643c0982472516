"""Sources and sinks: strict JSON lines, verified files, folders of documents, immutable publishing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from corvane.runtime import work_path


def strict_json(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines file or folder, and the lines that aren't records with the reason.

    Reasons: no_json, missing (a required field is null or blank). Blank lines are neither. A file without records gives
    an empty first frame.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter(F.col("line").rlike(r"\S"))
    bad = "_corrupt"
    shape = StructType(list(schema.fields)).add(bad, "string")
    x = lines.withColumn("r", F.from_json("line", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    blank = F.lit(False)
    for c in required:
        v = F.col("r")[c]
        blank = blank | v.isNull() | (F.trim(v.cast("string")) == "")
    reason = F.when(F.col("r").isNull() | F.col("r")[bad].isNotNull(), "no_json").when(blank, "missing")
    x = x.withColumn("reason", reason)
    return x.filter("reason is null").select("r.*").drop(bad), x.filter("reason is not null").select("file", "line", "reason")


def documents_in_folders(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Files below path with the given suffix: department (the folder), title and date (from title_YYYYMMDD), content.

    The date is null where the name has none or one that doesn't exist.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), re.escape(suffix) + "$", "")
    stamp = F.regexp_extract(name, r"_(\d{8})$", 1)
    date = F.try_to_timestamp(stamp, F.lit("yyyyMMdd")).cast("date")
    return files.select(F.element_at(parts, -2).alias("department"), F.regexp_replace(name, r"_\d{8}$", "").alias("title"), F.when(stamp != "", date).alias("date"), F.decode("content", "UTF-8").alias("content"))


def docx_in_folders(spark: SparkSession, path: str) -> DataFrame:
    """Word files below path as documents_in_folders gives texts, with error: why a file couldn't be read (then no content).

    Paragraphs become lines; other parts of the document are left out. A file is read in the task that holds it.
    """
    import io
    import zipfile
    from collections.abc import Iterator
    from xml.etree import ElementTree

    import pyarrow as pa

    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(raw: bytes) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return None, type(e).__name__
        return "\n".join("".join(t.text or "" for t in p.iter(f"{word}t")) for p in root.iter(f"{word}p")), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [text(raw) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in read], pa.string()), pa.array([r[1] for r in read], pa.string())], ["path", "content", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.docx$", "")
    stamp = F.nullif(F.regexp_extract(name, r"_(\d{8})$", 1), F.lit(""))
    date = F.try_to_timestamp(stamp, F.lit("yyyyMMdd")).cast("date")
    return files.mapInArrow(run, "path string, content string, error string").select(F.element_at(parts, -2).alias("department"), F.regexp_replace(name, r"_\d{8}$", "").alias("title"), date.alias("date"), "content", "error")


def texts_of(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a text that isn't blank, and the others, which have nothing to learn from."""
    good = F.coalesce(F.trim(text) != "", F.lit(False))
    return df.filter(good), df.filter(~good)


def verified_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, content and verified of the files matching path: whether the SHA-256 of the content is the one in the file of
    the same name with .sha256 behind it. A file without such a one isn't verified."""
    read = lambda p: spark.read.format("binaryFile").load(p).select("path", "content")
    kept = read(path).filter(~F.endswith("path", F.lit(".sha256")))
    sums = read(path).filter(F.endswith("path", F.lit(".sha256"))).select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.regexp_extract(F.decode("content", "UTF-8"), "^([0-9a-f]{64})", 1).alias("want"))
    return kept.join(sums, "path", "left").select("path", "content", F.coalesce(F.sha2("content", 256) == F.col("want"), F.lit(False)).alias("verified"))


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (relative), bytes and records of the Parquet files of a table, from its files themselves."""
    meta = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("records"))
    return meta.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "bytes", "records")


def identity(df: DataFrame) -> DataFrame:
    """records and digest of a frame, independent of the order of rows and of partitioning."""
    h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    return df.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> dict:
    """Write df to a path that must not exist, by way of a staging folder; give its identity as it was read back.

    The staging folder is renamed in one step after its identity is the same as df's, so readers never see a part.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(work_path(spark, "staged"))
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(staged.toString())
    read = identity(spark.read.schema(df.schema).parquet(staged.toString())).first().asDict()
    if read["records"] != df.count():
        raise OSError(f"{path}: {read['records']} records were written")
    system.mkdirs(target.getParent())
    if not system.rename(staged, target):
        raise OSError(f"{path}: renaming failed")
    return read


def publish_all(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Publish several tables together: if one fails, those that were published before it are taken back."""
    done: list[str] = []
    out: dict[str, dict] = {}
    try:
        for path, df in tables.items():
            out[path] = publish(df, path)
            done.append(path)
    except Exception:
        for path in done:
            spark = tables[path].sparkSession
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        raise
    return out


def publish_lines(df: DataFrame, path: str, by: str) -> dict:
    """Write df as JSON lines to path/records and its counts by a column, with the total, to path/stats; path must not exist."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    staged = jvm.org.apache.hadoop.fs.Path(work_path(spark, "staged"))
    df.write.json(f"{staged}/records")
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("-")).alias("value")).agg(F.count(F.lit(1)).alias("records"))
    counts.coalesce(1).write.json(f"{staged}/stats")
    system.mkdirs(target.getParent())
    if not system.rename(staged, target):
        raise OSError(f"{path}: renaming failed")
    return {"records": spark.read.text(f"{path}/records").count()}
