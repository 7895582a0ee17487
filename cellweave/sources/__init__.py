"""Readers and writers. Every reader is one lazy scan; every writer is distributed."""

from __future__ import annotations

import atexit
import configparser
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

PAGE = StructType(
    [
        StructField("docID", StringType()),
        StructField("url", StringType()),
        StructField("fullText", StringType()),
        StructField("tableNum", IntegerType()),
        StructField("category", StringType()),
        StructField("category_support_word_count", IntegerType()),
        StructField("termSet", ArrayType(StringType())),
    ]
)
PAIR_COLUMNS = (
    "doc_id mx_id mt_id sim_no_scale sim_max dif_sum scale prec unit mod aggr ltokn lnps gtokn gnps surface approx_sim mx mt scalex scalet gt func"
).split()


def json_lines(spark: SparkSession, paths, schema: StructType = PAGE) -> DataFrame:
    """One JSON object a line; malformed lines are dropped, unreadable files skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(paths)


def json_whole(spark: SparkSession, paths, schema: StructType = PAGE) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def json_stream(spark: SparkSession, path: str, schema: StructType = PAGE, files_per_batch: int = 8) -> DataFrame:
    """The same scan a few files at a time, as a stream."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def manifest(spark: SparkSession, path: str) -> list[str]:
    """File names listed in a text file, one a line."""
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) != ''").collect()]


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(value, name): distinct lower-case lines and the file each is from, for keyword and stop-word lists."""
    df = spark.read.option("pathGlobFilter", pattern).text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    return df.select(F.lower(F.trim("value")).alias("value"), name.alias("name")).where("value != ''").distinct()


def tsv(spark: SparkSession, paths, columns: list[str] | None = None, header: bool = False) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", header).csv(paths)
    return df.toDF(*columns) if columns else df


def part_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All part files below a folder."""
    df = spark.read.option("sep", "\t").option("recursiveFileLookup", True).option("pathGlobFilter", "part*").csv(path)
    return df.toDF(*columns) if columns else df


def keyed_lines(spark: SparkSession, paths, key: int) -> DataFrame:
    """(key, fields): lines split at white space, lines of one field dropped, fields after the key."""
    fields = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(paths).select(fields.alias("f")).where((F.size("f") >= 2) & (F.size("f") > key))
    return df.select(F.col("f")[key].alias("key"), F.slice("f", F.lit(key + 2), F.size("f")).alias("fields"))


def csv_corpus(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A quoted CSV table whose fields may hold new lines."""
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")


def settings(path: str, section: str) -> dict[str, str]:
    """A section of an ini file; raises if there is none."""
    parser = configparser.ConfigParser()
    with open(path, encoding="utf-8") as f:
        parser.read_file(f)
    if not parser.has_section(section):
        raise KeyError(f"no section {section} in {path}")
    return dict(parser.items(section))


def jdbc(spark: SparkSession, options: dict[str, str], query: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A query of a database, read in parallel by ranges of an integer key."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", f"({query}) q")
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").csv(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_by_category(df: DataFrame, path: str, category: str = "category", rows_per_file: int = 1000) -> None:
    """A folder a category, files of bounded size."""
    df.write.option("maxRecordsPerFile", rows_per_file).partitionBy(category).json(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).parquet(path)


def write_jdbc(df: DataFrame, options: dict[str, str], table: str) -> None:
    """Bulk insert; keys are made before, so no row waits for one."""
    df.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()


def not_yet(df: DataFrame, journal: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not in the journal, each key once."""
    return df.dropDuplicates([key]).join(journal.select(key).distinct(), key, "left_anti")


def with_key(df: DataFrame, *natural: str, name: str = "id") -> DataFrame:
    """A surrogate key from natural keys, equal on every run."""
    return df.withColumn(name, F.xxhash64(*natural))


def entities(documents: DataFrame, tables: DataFrame, mentions: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """The tables of an annotation set with surrogate keys and foreign keys."""
    d = with_key(documents, "page_id", "doc_no")
    t = with_key(tables, "page_id", "table_no").join(d.select("page_id", F.col("id").alias("document_id")), "page_id")
    m = with_key(mentions, "page_id", "doc_no", "mention_id").join(d.select("page_id", "doc_no", F.col("id").alias("document_id")), ["page_id", "doc_no"])
    k = links.select(F.xxhash64("page_id", "doc_no", "mention_id").alias("mention_key"), F.xxhash64("page_id", "table_no").alias("table_key"))
    return {"document": d, "table": t, "mention": m, "mention_table": k}




_OWN: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; local masters may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="cellweave-scratch-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = _OWN["dir"]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A table written to a shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
