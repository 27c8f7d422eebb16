"""Reading and writing files as DataFrames."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert, extract, paths


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share; on one machine (tests), of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, or of this pattern."""
    fs, where = _at(spark, path)
    return bool(fs.globStatus(where))


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; false if there was none."""
    fs, where = _at(spark, path)
    return fs.delete(where, True)


def tree(spark: SparkSession, root: str, glob: str = "*", exact: tuple[str, ...] = (), words: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), folders: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), modified, n_bytes, content of the files that the name rules let through.

    exact, words: names of files and folders that are left out; include overrides exclude (extensions with their
    point); folders: if any, every folder above a file must be among them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), f"^\\Q{base}\\E/*", "")
    rows = raw.select(rel.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("n_bytes"), "content")
    ok = ~F.exists(F.split("path", "/"), lambda x: paths.excluded_name(x, exact, words))
    return rows.where(ok & paths.allowed_extension(F.col("path"), include, exclude) & paths.allowed_folders(F.col("path"), folders))


_ENTRIES = "folder string, name string, is_dir boolean, modified double, n_bytes long"


def _entries(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """What lies in each folder (full paths), listed by the tasks that have the folders; links to folders aren't followed.

    Folders of other stores than shared mounts are listed by the driver through Hadoop, one at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["folder"]:
                with os.scandir(re.sub(r"^file:/*", "/", folder)) as found:
                    rows += [(folder, e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False).st_mtime, e.stat(follow_symlinks=False).st_size) for e in found]
            yield pd.DataFrame(rows, columns=["folder", "name", "is_dir", "modified", "n_bytes"])

    remote = folders.where(F.col("folder").rlike(r"^(?!file:)\w+:"))
    if not remote.limit(1).count():
        return folders.mapInPandas(run, _ENTRIES)
    rows = []
    for r in remote.toLocalIterator():
        fs, where = _at(spark, r.folder)
        rows += [(r.folder, e.getPath().getName(), e.isDirectory(), e.getModificationTime() / 1000, e.getLen()) for e in fs.listStatus(where)]
    return spark.createDataFrame(rows, _ENTRIES)


def walk(spark: SparkSession, root: str, exact: tuple[str, ...] = (), words: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), folders: tuple[str, ...] = (), tasks: int = 64) -> DataFrame:
    """path (below root), is_dir, modified, n_bytes of the folders entered and of the files that the name rules let through.

    Level by level, tasks list the folders of the last one; a folder that the rules leave out is never entered, so nothing
    below it is listed.  The rules are those of `tree`.  A root that is missing gives no rows.  Each level is a table in the
    shared folder, so a lost executor's folders alone are listed again.
    """
    none = spark.createDataFrame([], "path string, is_dir boolean, modified timestamp, n_bytes long")
    if not exists(spark, root):
        return none
    at, base, level = scratch_dir(spark, "walk"), root.rstrip("/"), 0
    frontier = spark.createDataFrame([(base,)], "folder string")
    found = none
    allowed = F.lower("name").isin(*(x.lower() for x in folders)) if folders else F.lit(True)
    while frontier.limit(1).count():
        listed = _entries(spark, frontier.repartition(tasks)).where(~paths.excluded_name(F.col("name"), exact, words))
        listed = listed.where(F.when(F.col("is_dir"), allowed).otherwise(paths.allowed_extension(F.col("name"), include, exclude)))
        listed.withColumn("full", F.concat_ws("/", "folder", "name")).write.parquet(f"{at}/{level}")
        rows = spark.read.schema(f"{_ENTRIES}, full string").parquet(f"{at}/{level}")
        found = found.unionByName(rows.select(F.substr("full", F.lit(len(base) + 2)).alias("path"), "is_dir", F.timestamp_seconds("modified").alias("modified"), "n_bytes"))
        frontier, level = rows.where("is_dir").select(F.col("full").alias("folder")), level + 1
    return found


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: a row a file; no row for what is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_text(df: DataFrame, path: str, append: bool = False, end: str = "\n") -> None:
    """A column of texts as files of many texts each, with `end` behind each one."""
    df.write.mode("append" if append else "overwrite").option("lineSep", end).text(path)


def read_texts(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """text: what `write_text` wrote with the same end, a row a text."""
    return spark.read.option("lineSep", end).text(path).select(F.col("value").alias("text"))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, document (variant): null for an empty or broken file."""
    return read_text(spark, path).select("path", F.when(convert.is_json(F.col("text")), F.try_parse_json("text")).alias("document"))


def json_entries(df: DataFrame, column: str) -> DataFrame:
    """key, value (text) of each JSON object in a text column."""
    m = F.from_json(F.col(column), "map<string, string>")
    return df.select(*(c for c in df.columns if c != column), F.explode(m).alias("key", "value"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report of a few rows as one file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.option("header", True).csv(path) if kind == "csv" else one.json(path)


_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _slides(content: bytes) -> list[tuple[int, str, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for number, name in names:
            lines = ["".join(t.text or "" for t in p.iter(f"{_DRAW}t")) for p in ElementTree.fromstring(z.read(name)).iter(f"{_DRAW}p")]
            lines = [x for x in lines if x.strip()]
            if lines:
                out.append((number, lines[0], "\n".join(lines)))
    return out


def deck(slides: list[list[str]]) -> bytes:
    """A .pptx file with only what `slides` reads: a paragraph for each text of each slide."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, lines in enumerate(slides, 1):
            body = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p:sld xmlns:a="{_DRAW[1:-1]}" xmlns:p="urn:p">{body}</p:sld>')
    return out.getvalue()


def slides(files: DataFrame) -> DataFrame:
    """path, slide (from 1), title ("No Title" if none), text of .pptx files (path, content); empty slides are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, n, title or "No Title", text) for n, title, text in _slides(content)]
                except (zipfile.BadZipFile, ElementTree.ParseError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "slide", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, slide int, title string, text string")


def document_pipeline(files: DataFrame, text_of: Callable[[DataFrame], DataFrame], function: Callable[[str], str], out: str, size: int = 2000, overlap: int = 200) -> None:
    """Texts of files (path, content) by `text_of` (`pdf_text`, or any that gives path and text), cut into chunks, a
    caller's function on each, and the results (path, chunk_index, content, error) as Parquet at `out`."""
    extract.map_chunks(extract.chunk_rows(text_of(files), "path", "text", size, overlap), function).write.parquet(out)


def pdf_text(files: DataFrame) -> DataFrame:
    """path, text of .pdf files (path, content), pages joined without a separator; needs pypdfium2 on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdfium2

        for b in batches:
            texts = ["".join(p.get_textpage().get_text_range() for p in pypdfium2.PdfDocument(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
