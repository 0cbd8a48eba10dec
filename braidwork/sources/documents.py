"""Documents from files: txt, docx and pdf. The reader of each kind is a function that may be replaced."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import clean_text
from braidwork.runtime import prepare

KINDS = ("pdf", "txt", "docx", "doc")


def read_txt(data: bytes) -> str:
    return data.decode("utf-8")


def read_docx(data: bytes) -> str:
    """The paragraphs of a Word file, joined by empty lines."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))


def read_pdf(data: bytes) -> str:
    """Pages joined by empty lines; needs pypdf."""
    import pypdf

    return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


READERS: dict[str, Callable[[bytes], str]] = {"txt": read_txt, "docx": read_docx, "doc": read_docx, "pdf": read_pdf}


def _empty_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path of the files without a byte, which Spark lists but leaves out of its scan."""
    jvm = spark.sparkContext._jvm
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(files._jdf.inputFiles())
    listed = DataFrame(spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    plain = F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B")))  # the list has URLs, the scan paths
    return listed.select(F.regexp_replace(plain, "^([^:/]+):///", "$1:/").alias("path")).join(files.select("path"), "path", "left_anti")


def load_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents (id, title, content, source_path, metadata, ord) under a path, cleaned, and (source_path, error) of files that can't be read.

    Files of other kinds are left out; an empty text file is a document without text. The path may be a directory, a pattern or a file.
    """
    prepare(spark)
    readers = {**READERS, **(readers or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    files = files.unionByName(_empty_files(spark, files).withColumn("content", F.lit(b"")))
    files = files.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).filter(F.col("kind").isin(*KINDS))

    @F.pandas_udf("content string, error string")
    def read(kinds: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for kind, body in zip(kinds, data, strict=True):
            try:
                out.append((readers[kind](bytes(body)), None))
            except Exception as error:  # noqa: BLE001  a bad file is skipped and reported
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["content", "error"])

    rows = files.select("path", "kind", read("kind", "content").alias("r")).select("path", "kind", "r.*")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    good = rows.filter("error is null").select(stem.alias("id"), stem.alias("title"), clean_text(F.col("content")).alias("content"), F.col("path").alias("source_path"), F.create_map(F.lit("file_type"), F.col("kind")).alias("metadata"), F.xxhash64("path").alias("ord"))
    return good, rows.filter("error is not null").select(F.col("path").alias("source_path"), "error")


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """One file's document. A missing file or another kind raises."""
    kind = (re.findall(r"\.([^./]+)$", path) or [""])[0].lower()
    if kind not in KINDS:
        raise ValueError(f"unsupported file type: .{kind}")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    return load_documents(spark, path)[0]


def load_config(path: str) -> dict:
    """A YAML file's content; {} if it is missing or empty."""
    import os

    import yaml

    if not os.path.exists(path):
        return {}
    with open(path) as f:
        return yaml.safe_load(f) or {}


def sample_documents(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """A Parquet table of documents, or its first `size` rows by ord."""
    rows = spark.read.parquet(path)
    return rows if size is None else rows.orderBy("ord").limit(size)
