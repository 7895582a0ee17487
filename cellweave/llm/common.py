"""Helpers shared by the corpus operators: shared-folder tables, row keys, word arrays.

Every helper here is a DataFrame or Column expression; nothing collects rows. Tables that operators
write go below one folder of the driver's run, which is deleted when the driver ends; ``released``
deletes one earlier, once nothing reads it any more.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and TAB..CR.
WS_CLASS = r"[\x20\x09-\x0D]"
#: What separates benchmark words once A-Z are lower case.
TERM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_OWN: dict[str, str] = {}
_RUNS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


def _deleted(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _deleted_at_end(spark: SparkSession, path: str) -> None:
    try:
        _deleted(spark, path)
    except Exception as e:  # the JVM may be gone before Python ends
        print(f"left behind: {path} ({type(e).__name__})", file=sys.stderr)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    base = shared_folder(spark)
    if base not in _RUNS:
        _RUNS[base] = f"{base}/cellweave-{uuid.uuid4().hex}"
        atexit.register(_deleted_at_end, spark, _RUNS[base])
    path = f"{_RUNS[base]}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave, when what was made of them is written itself."""
    for t in tables:
        _deleted(t.sparkSession, t._written)


def free_names(df: DataFrame, n: int) -> list[str]:
    """Column names that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return list(itertools.islice((f"_x{i}" for i in itertools.count() if f"_x{i}" not in taken), n))


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by quoted name, so that names with dots are columns too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keep_rows(docs: DataFrame, marks: DataFrame, how: str, rows: int | None = None, bound: int = 0) -> DataFrame:
    """Rows of ``docs`` that have ("left_semi") or have not ("left_anti") their doc_id and text hash in ``marks``.

    ``marks`` (doc_id, th) is broadcast if it has ``rows`` rows and they are within ``bound``.
    """
    i, h, own = free_names(docs, 3)
    side = marks.select(F.col("doc_id").alias(i), F.col("th").alias(h))
    if rows is not None:
        side = guarded(side, rows, bound)
    out = docs.withColumn(own, text_hash()).join(side, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)), how)
    return out.drop(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(docs: DataFrame) -> Column:
    """doc_id as a value that has an order and is never null: null is the smallest."""
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return F.coalesce(F.concat(F.lit(" "), F.col("doc_id").cast("string")), F.lit(""))


def text_hash(text: Column | str = "text") -> Column:
    """Tells rows of one doc_id apart; rows equal in both are one document to the operators that join back."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def ws_words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. Texts of single-byte characters take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def terms(text: Column) -> Column:
    """Benchmark words: ASCII letters in lower case, digits and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), TERM_BREAK), "")


def guarded(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcasts a side whose row count has been taken and is within its bound; else the join shuffles."""
    return F.broadcast(df) if rows <= bound else df
