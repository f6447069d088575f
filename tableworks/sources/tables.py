"""Readers and writers for tables, text folders, record logs and vector indexes."""

from __future__ import annotations

import bz2
import gzip
import os
import re
import time
import zlib
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import is_json
from ..operators.ordering import global_position
from ..session import scratch_path

EXPERIMENT_SCHEMA = (
    "task STRING, dataset_shape ARRAY<BIGINT>, target STRING, model STRING, metrics MAP<STRING, DOUBLE>, "
    "best_params STRING, timestamp DOUBLE, date STRING"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system, so object stores and globs work too."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def read_table(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Parquet by suffix, anything else as CSV with a header.

    Give a schema to spare a CSV its type inference pass. ``multi_line`` allows line breaks in
    quoted cells, at the price of one task per file.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Cannot find file: {path}")
    if path.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: Files named to Python at a time, bytes of texts that it hands over at a time, and files and bytes that a task reads.
LISTED, HANDED, FILES_PER_TASK, BYTES_PER_TASK = 10_000, 8 << 20, 20_000, 64 << 20
#: How Hadoop's readers unpack a file by its ending; of formats that are Hadoop's own, Spark's reader takes the files.
_UNPACK = {".gz": gzip.decompress, ".bz2": bz2.decompress, ".deflate": zlib.decompress}
_HADOOPS_OWN = r"\.(zst|lz4|snappy)$"
#: Names that Spark's readers pass over, files and folders, and characters of a path that are quoted in a location.
_HIDDEN = r"^\.|^_(?!.*=)|\._COPYING_$"
_QUOTED = re.compile(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\x80-\U0010ffff]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_text_corpus(spark: SparkSession, path: str, *, glob: str | None = None) -> DataFrame:
    """Every file below ``path``, one row each, with its location. Files that are empty or hidden are left out and packed ones unpacked
    by their ending, as Spark's text reader does.

    Folders are listed level by level in tasks and the files are dealt to tasks from a table, as Spark's own index holds all files in the
    driver, and a partition list of them too. Paths of file systems that Arrow has no access to are read through that index.
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    system = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    roots = [r.getPath().toUri() for r in system.globStatus(hpath) or ()]
    uris = [r.toASCIIString() for r in roots]
    try:
        tops = [_opened(uri) for uri in uris]
    except (pa.ArrowException, OSError):
        tops = []
    if not tops:
        return _indexed_texts(spark, [path], glob)
    local = uris[0].startswith("file:")
    paths = [r.getPath() if local else top for r, (_, top) in zip(roots, tops)]
    infos = tops[0][0].get_file_info(paths)
    start = [(p, info.type == fs.FileType.Directory, info.size or 0) for p, info in zip(paths, infos)]
    files = _files_below(spark, uris[0], start)
    if glob:
        files = files.where(F.col("name").rlike(f"^(?:{jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()})$"))
    # a path of Arrow's is the end of its URI
    prefix = "file:" if local else uris[0].removesuffix(quote(paths[0], safe="/_-!.~'()*,;:$&+=@"))
    packed = F.lower("name").rlike(_HADOOPS_OWN)
    own = [r.path for r in files.where(packed).select("path").collect()]
    texts = _texts_of(files.where(~packed), uris[0], prefix)
    return texts.unionByName(_indexed_texts(spark, [prefix + p for p in own])) if own else texts


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), "/") if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _indexed_texts(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))


def _files_below(spark: SparkSession, uri: str, start: list[tuple[str, bool, int]]) -> DataFrame:
    """(path, folder, size, name) of the files at and below ``start``: a table for each level of folders, each folder listed by one task."""
    schema = "path string, folder boolean, size long"

    def entries(target, folder):
        if isinstance(target, fs.LocalFileSystem):  # one by one; other systems give a folder's list at once
            with os.scandir(folder) as found:
                for e in found:
                    if e.is_dir() or e.is_file():
                        yield e.path, e.is_dir(), e.stat().st_size
        else:
            for e in target.get_file_info(fs.FileSelector(folder)):
                yield e.path, e.type == fs.FileType.Directory, e.size or 0

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64()))], names=["path", "folder", "size"])

    def listed(batches):
        target, _ = _opened(uri)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for entry in entries(target, folder):
                    rows.append(entry)
                    if len(rows) == LISTED:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    name = F.regexp_extract("path", "([^/]*)/*$", 1)
    found, levels = spark.createDataFrame(start, schema).withColumn("name", name), []
    folders = found.where("folder")
    while True:
        # a root is read whatever its name, if it is no file
        levels.append(found.where(~F.col("folder") & (F.col("size") > 0) & ~F.col("name").rlike(_HIDDEN)))
        n = folders.count()
        if n == 0:
            return reduce(DataFrame.unionByName, levels)
        path = scratch_path(spark, "files")
        dealt = folders.select("path").repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
        dealt.mapInArrow(listed, schema).write.parquet(path)
        found = spark.read.schema(schema).parquet(path).withColumn("name", name)
        folders = found.where(F.col("folder") & ~F.col("name").rlike(_HIDDEN))


def _texts_of(files: DataFrame, uri: str, prefix: str) -> DataFrame:
    n, size = files.agg(F.count("*"), F.sum("size")).first()
    parts = max(2 * files.sparkSession.sparkContext.defaultParallelism, n // FILES_PER_TASK, (size or 0) // BYTES_PER_TASK)

    def read(batches):
        target, _ = _opened(uri)

        def table(texts, sources):
            return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(sources, pa.string())], names=["text", "source"])

        for batch in batches:
            texts, sources, held = [], [], 0
            for path in batch.column(0).to_pylist():
                with target.open_input_stream(path, compression=None) as file:
                    data = file.read()
                for ending, unpack in _UNPACK.items():
                    if path.lower().endswith(ending):
                        data = unpack(data)
                texts.append(data)
                sources.append(prefix + _QUOTED.sub(lambda m: quote(m[0]), path))
                held += len(data)
                if held >= HANDED:
                    yield table(texts, sources)
                    texts, sources, held = [], [], 0
            if texts:
                yield table(texts, sources)

    found = files.select("path").repartition(max(1, min(n, parts))).mapInArrow(read, "text binary, source string")
    return found.select(F.col("text").cast("string").alias("text"), "source")


#: Characters that a folder name of a partition column cannot hold as they are.
_UNSAFE = {chr(c): f"%{c:02X}" for c in [*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^"]}


def write_text_corpus(df: DataFrame, path: str, *, text: str, by: str) -> None:
    """A file per row, in a folder per value of ``by``, each text ended by a line end (null is empty): what Spark's text writer leaves
    with one record per file. Files are written through the file system of the path's URI by the tasks themselves, as a writer that is set up
    and committed for each file takes many times longer. A task that is run again writes the same names; rows keep their place in a task,
    so ``df`` has to be a scan or a stored table."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()

    def run(batches):
        target, root = fs.FileSystem.from_uri(uri)
        task, at, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for value, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = "".join(_UNSAFE.get(c, c) for c in value) if value else "__HIVE_DEFAULT_PARTITION__"
                folder = f"{root}/{by}={name}"
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                with target.open_output_stream(f"{folder}/part-{task:05d}-{at:09d}.txt") as file:
                    file.write(f"{data or ''}\n".encode())
                at += 1
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["n"])

    df.select(F.col(by).cast("string"), F.col(text)).mapInArrow(run, "n long").agg(F.sum("n")).first()


def read_jsonl_lenient(
    spark: SparkSession, path: str, *, schema: T.StructType | str = EXPERIMENT_SCHEMA, keep_bad: bool = False
) -> DataFrame:
    """One JSON record per line. Blank lines are skipped; broken ones are skipped too, or kept
    in ``bad_line`` with a null record."""
    lines = spark.read.text(path).select(F.trim("value").alias("_line")).where(F.length("_line") > 0)
    ok = is_json(F.col("_line"))
    if not keep_bad:
        return lines.where(ok).select(F.from_json("_line", schema).alias("r")).select("r.*")
    return lines.select(
        F.when(ok, F.from_json("_line", schema)).alias("r"), F.when(~ok, F.col("_line")).alias("bad_line")
    ).select("r.*", "bad_line")


def append_jsonl(df: DataFrame, path: str, *, reset: bool = False, now: float | None = None) -> None:
    """Stamp a batch of records and append it to a log folder; ``reset`` empties the log first."""
    stamp = time.time() if now is None else now
    date = time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(stamp))
    if reset:
        df.limit(0).write.mode("overwrite").json(path)
    stamped = df.drop("timestamp", "date").withColumns({"timestamp": F.lit(float(stamp)), "date": F.lit(date)})
    stamped.write.mode("append").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_records_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_pages(df: DataFrame, path: str, *, by: list[str]) -> None:
    """Page artefacts as a Parquet table laid out in ranges of ``by`` (document, page, segment), not a file per page. A document with
    very many pages is spread over several files. The pages are made once, into a table that is removed at the end: finding the ranges reads
    its input a second time."""
    spark, made = df.sparkSession, f"{path.rstrip('/')}-unsorted"
    df.write.mode("overwrite").parquet(made)
    rows = spark.read.schema(df.schema).parquet(made)
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def read_binary_images(spark: SparkSession, path: str, *, column: str = "image") -> DataFrame:
    """Images as bytes: a Parquet table with an ``image.bytes`` struct, or a folder of files."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.withColumns({"bytes": F.col(f"{column}.bytes"), "path": F.col(f"{column}.path")}).drop(column)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("content").alias("bytes"), "path", "length")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def build_vector_index(df: DataFrame, path: str, *, vector: str, dim: int, overwrite: bool = True) -> DataFrame:
    """Write vectors with their payload under generated ids; a wrong dimension stops the job. Appended rows get ids above all
    stored ones. One writer at a time: two appends at once would start from the same id."""
    spark, first = df.sparkSession, 0
    if not overwrite and _exists(spark, path):
        highest = spark.read.parquet(path).agg(F.max("id")).first()[0]
        first = 0 if highest is None else highest + 1
    size_ok = F.size(vector) == dim
    checked = F.when(size_ok, F.col(vector)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.coalesce(F.size(vector).cast("string"), F.lit("null"))))
    )
    rows = df.withColumn(vector, checked).withColumn("id", F.monotonically_increasing_id() + F.lit(first))
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)
    return df.sparkSession.read.parquet(path)


def replicate_to(df: DataFrame, *, n: int, key: str) -> DataFrame:
    """Exactly ``n`` rows: whole copies in key order, then the first rows of one more copy.

    Adds ``row_no``, the 0-based place in the result.
    """
    size = df.count()
    ranked = global_position(df, key=key, out="_pos", rows=size)
    if size == 0 or n <= 0:
        return ranked.withColumn("row_no", F.col("_pos")).drop("_pos").limit(0)
    full, rest = divmod(n, size)
    copies = F.lit(full) + F.when(F.col("_pos") < rest, 1).otherwise(0)
    out = ranked.withColumn("_c", copies).where(F.col("_c") > 0)
    out = out.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    return out.withColumn("row_no", F.col("_rep") * F.lit(size) + F.col("_pos")).drop("_pos", "_c", "_rep")
