"""Directories of text files as document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from charterloom.functions.text import collapse_whitespace
from charterloom.sources.tables import numbered


def read_directory(spark: SparkSession, path: str, suffix: str = ".txt", corpus: int = 1) -> DataFrame:
    """(corpus, name, path, text) of every file below ``path``; files that are no UTF-8 are left out, a missing folder is empty."""
    schema = "corpus int, name string, path string, text string"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    body = F.col("content").cast("string")
    name = F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]*)$", 1)
    return files.where(F.is_valid_utf8(body)).select(F.lit(corpus).alias("corpus"), name.alias("name"), "path", collapse_whitespace(body).alias("text"))


def long_enough(docs: DataFrame, min_length: int) -> DataFrame:
    """Documents with a text of at least ``min_length`` code points, never an empty one."""
    return docs.where((F.char_length("text") > 0) & (F.char_length("text") >= min_length))


def first_per_group(docs: DataFrame, group: str, order: list[str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group.

    The rank filter lets Spark keep only that many rows of a group on each
    task before the shuffle, so a hot group is cut before it is gathered.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return docs.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def load_corpora(spark: SparkSession, path: str, path2: str = "", suffix: str = ".txt", min_length: int = 150, keep: int = 10_000) -> tuple[DataFrame, bool]:
    """Documents of one or two folders with ``doc_idx``, and whether two corpora are compared.

    The order is that of the paths.  An empty first corpus is an error, an
    empty second one means that the first is compared with itself.
    """
    parts = []
    for number, folder in ((1, path), (2, path2)):
        if folder:
            docs = long_enough(read_directory(spark, folder, suffix, number), min_length)
            parts.append(first_per_group(docs, "corpus", ["path"], keep))
    if not parts or parts[0].isEmpty():
        raise ValueError(f"no texts in {path!r}")
    two = len(parts) > 1 and not parts[1].isEmpty()
    docs = parts[0].unionByName(parts[1]) if two else parts[0]
    return numbered(docs, ["corpus", "path"], "doc_idx").select(F.col("doc_idx").cast("bigint").alias("doc_idx"), "corpus", "name", "path", "text"), two
