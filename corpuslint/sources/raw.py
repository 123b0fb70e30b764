"""Bytes of all files below any number of paths, whatever their names.

Two ways lead to a file. Spark's own reader opens every store that Spark opens, with its credentials, and lists folders
in distributed jobs, but leaves out names that begin with ``_`` or ``.``, as ``__init__.py`` does. So paths that Arrow's file
systems open (local ones and URIs alike) are listed and read by tasks here instead: level by level, one job a depth, every
folder dealt to a task of its own. All other paths go through Spark's reader. Paths can also come as a table of any
length; they are read where they are and never pass through the driver. A path that is missing, cannot be read or does not
fit in one cell becomes a row with an error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.storage import saved

MOST_BYTES = 2_000_000_000
BATCH_BYTES = 32 << 20
RAW = "path string, content binary, error string"
LISTED = "path string, size long, error string, folder boolean"


def _file_system(path: str):
    import os

    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        return system, inner, path[: len(path) - len(inner)]
    local = path.removeprefix("file://").removeprefix("file:")
    return fs.LocalFileSystem(), os.path.abspath(local), ""


def _by_value(function):
    """A copy that workers need not import this module for."""
    import types

    return types.FunctionType(function.__code__, {"__builtins__": __builtins__}, function.__name__)


def _arrow_opens(path: str) -> bool:
    try:
        system, inner, _ = _file_system(path)
        system.get_file_info(inner)
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def _spark_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    if _arrow_opens(path):
        system, inner, _ = _file_system(path)
        return system.get_file_info(inner).type.name != "NotFound"
    there, system = _spark_path(spark, path)
    return system.exists(there)


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _wanted(path: Column, suffixes: tuple[str, ...] | None) -> Column:
    """Suffixes are compared in lower case; a name that only begins with a dot has none."""
    ending = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.lit(True) if suffixes is None else ending.isin(*suffixes)


def listed(spark: SparkSession, roots: list[str], recursive: bool, excluded: tuple[str, ...]) -> DataFrame:
    """Everything at and below ``roots`` as ``LISTED``, level by level; a root that is a file has the folder null."""
    file_system = _by_value(_file_system)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [field.split()[0] for field in LISTED.split(", ")]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, is_root in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    system, inner, head = file_system(path)
                    info = system.get_file_info(inner) if is_root else None
                    if info and info.type == fs.FileType.NotFound:
                        rows.append((path, None, "no such file or directory", None))
                    elif info and info.type != fs.FileType.Directory:
                        rows.append((head + info.path, info.size, None, None))
                    else:
                        for item in system.get_file_info(fs.FileSelector(inner)):
                            folder = item.type == fs.FileType.Directory
                            if not folder or item.base_name not in excluded:
                                rows.append((head + item.path, item.size, None, folder))
                            if len(rows) > 10_000:
                                yield block(rows)
                                rows = []
                except Exception as error:
                    rows.append((path, None, str(error), None))
                if rows:
                    yield block(rows)

    levels = []
    waiting = spark.createDataFrame([(root, True) for root in dict.fromkeys(roots)], "path string, is_root boolean")
    while True:
        found = saved(waiting.repartition(_parts(spark), "path").mapInArrow(entries, LISTED))
        levels.append(found)
        waiting = found.filter("folder").select("path", F.lit(False).alias("is_root")).distinct()
        if not recursive or waiting.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def loaded(paths: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The files of a table (path, size, error) as ``RAW``, read by tasks; a row with an error is passed on."""
    spark = paths.sparkSession
    file_system, batch_bytes = _by_value(_file_system), BATCH_BYTES

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            path, content, error = zip(*held)
            return pa.record_batch(
                [pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())],
                names=["path", "content", "error"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                content, error, length = None, row["error"], row["size"]
                if error is None:
                    try:
                        system, inner, _ = file_system(row["path"])
                        if length is None:
                            info = system.get_file_info(inner)
                            length = info.size or 0
                            if info.type != fs.FileType.File:
                                error = "no such file" if info.type == fs.FileType.NotFound else "not a file"
                        if error is None and length > most_bytes:
                            error = f"larger than {most_bytes} bytes"
                        if error is None:
                            with system.open_input_stream(inner) as stream:
                                content = stream.read()
                    except Exception as problem:
                        error = str(problem)
                if held and size + len(content or b"") > batch_bytes:
                    yield block()
                    held, size = [], 0
                held.append((row["path"], content, error))
                size += len(content or b"")
        if held:
            yield block()

    return paths.repartition(_parts(spark), "path").mapInArrow(load, RAW)


def table_files(paths: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``RAW`` rows of a table's column ``path``, every path once; null paths are left out. Nothing of it is collected."""
    once = paths.select(F.col("path").cast("string")).filter("path IS NOT NULL").distinct()
    return loaded(once.select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("error")), most_bytes)


def _spark_files(
    spark: SparkSession, root: str, recursive: bool, suffixes: tuple[str, ...] | None, excluded: tuple[str, ...],
    most_bytes: int, any_explicit: bool,
) -> DataFrame:
    """``RAW`` rows of one root through Spark's reader."""
    there, system = _spark_path(spark, root)
    if not system.exists(there):
        return spark.createDataFrame([(root, None, "no such file or directory")], RAW)
    status = system.getFileStatus(there)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("path")
    if not (any_explicit and status.isFile()):
        files = files.where(_wanted(path, suffixes))
    if status.isDirectory():
        below = F.substring(path, F.lit(len(status.getPath().toString()) + 2), F.length(path))
        folders = F.split(F.regexp_replace(below, r"[^/]*$", ""), "/")
        if excluded:
            files = files.where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in excluded])))
        if not recursive:
            files = files.where(~below.contains("/"))
    large = files.where(F.col("length") > most_bytes).select(
        "path", F.lit(None).cast("binary").alias("content"), F.lit(f"larger than {most_bytes} bytes").alias("error")
    )
    fitting = files.where(F.col("length") <= most_bytes)
    return fitting.select("path", "content", F.lit(None).cast("string").alias("error")).unionByName(large)


def raw_files(
    spark: SparkSession, roots: list[str], recursive: bool = True, suffixes: tuple[str, ...] | None = None,
    excluded: tuple[str, ...] = (), most_bytes: int = MOST_BYTES, any_explicit: bool = False,
) -> DataFrame:
    """``path, content, error`` of files and directories, every file once. Directories named in ``excluded`` are not
    entered below a root. With ``any_explicit`` a path that is a file itself may have any name."""
    here = [root for root in dict.fromkeys(roots) if _arrow_opens(root)]
    found = []
    if here or not roots:
        rows = listed(spark, here, recursive, excluded).where("NOT coalesce(folder, false)")
        explicit = F.col("folder").isNull() if any_explicit else F.lit(False)
        rows = rows.where(F.col("error").isNotNull() | _wanted(F.col("path"), suffixes) | explicit)
        found.append(loaded(rows.select("path", "size", "error").dropDuplicates(["path"]), most_bytes))
    for root in dict.fromkeys(roots):
        if root not in here:
            found.append(_spark_files(spark, root, recursive, suffixes, excluded, most_bytes, any_explicit))
    every = reduce(DataFrame.unionByName, found)
    return every if len(found) == 1 else every.dropDuplicates(["path"])
