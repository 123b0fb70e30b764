"""File tables: directory scans, explicit lists and tables that already hold text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .raw import exists, raw_files, table_files

# What a scan reads and which directories it leaves out.
SCAN_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h",
)
EXCLUDED_DIRECTORIES = (
    "node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", ".idea", ".vscode",
)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def decode(raw: Column) -> Column:
    """UTF-8 text without the undecodable bytes; a U+FFFD that the file itself holds stays.

    Undecodable bytes turn into U+FFFD, so before that the genuine ones are written as U+FFFE and 1, and U+FFFE as
    U+FFFE and 0, byte by byte."""
    text = raw.cast("string")
    single = F.decode(raw, "ISO-8859-1")
    escaped = F.replace(F.replace(single, F.lit("ï¿¾"), F.lit("ï¿¾0")), F.lit("ï¿½"), F.lit("ï¿¾1"))
    valid = F.make_valid_utf8(F.encode(escaped, "ISO-8859-1").cast("string"))
    dropped = F.replace(valid, F.lit("\ufffd"), F.lit(""))
    repaired = F.replace(F.replace(dropped, F.lit("\ufffe1"), F.lit("\ufffd")), F.lit("\ufffe0"), F.lit("\ufffe"))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def universal_newlines(text: Column) -> Column:
    return F.when(
        text.contains("\r"), F.regexp_replace(text, F.lit("\r\n?"), F.lit("\n"))
    ).otherwise(text)


def files_from_table(
    table: DataFrame, path: Column, content: Column, file_id: Column | None = None
) -> DataFrame:
    """Any table with a path and a text becomes a file table. ``file_id`` must be unique
    per row; the path serves when there is nothing better."""
    named = table.select(
        (path if file_id is None else file_id).cast("string").alias("file_id"),
        path.alias("path"),
        universal_newlines(content).alias("content"),
    )
    return named.select(
        "file_id", "path", file_name(F.col("path")).alias("file_name"),
        suffix(F.col("path")).alias("ext"), "content",
    )


def supported(files: DataFrame, suffixes=SCAN_SUFFIXES) -> DataFrame:
    """Keep files with one of the suffixes."""
    return files.where(F.col("ext").isin(*suffixes))


def outside_directories(files: DataFrame, root: str = "", excluded=EXCLUDED_DIRECTORIES) -> DataFrame:
    """Drop files below a directory of one of the given names. Only directories below
    ``root`` count, so a project that itself lives in ``build/`` is still read."""
    below = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))
    parts = F.split(F.regexp_replace(below, r"[^/]*$", ""), "/")
    return files.where(~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in excluded])))


def _decoded(raw: DataFrame, suffixes) -> DataFrame:
    files = files_from_table(raw.where("error IS NULL"), F.col("path"), decode(F.col("content")))
    return supported(files, suffixes)


def scan(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    suffixes=SCAN_SUFFIXES,
    excluded=EXCLUDED_DIRECTORIES,
) -> DataFrame:
    """Files of one directory, or a single file, whatever their names. Files of other kinds are never opened. Of stores
    that only Spark can open, names that its readers hide (beginning with ``_`` or ``.``) are out of reach."""
    if not exists(spark, root):
        raise FileNotFoundError(root)
    return scan_paths(spark, [root], recursive, suffixes, excluded)


def scan_paths(
    spark: SparkSession, paths: list[str], recursive: bool = True, suffixes=SCAN_SUFFIXES,
    excluded=EXCLUDED_DIRECTORIES,
) -> DataFrame:
    """Any number of files or directories in one scan, every file once. See ``scan_errors`` for those left out."""
    return _decoded(raw_files(spark, paths, recursive, tuple(suffixes), tuple(excluded)), suffixes)


def scan_errors(
    spark: SparkSession, paths: list[str], recursive: bool = True, suffixes=SCAN_SUFFIXES,
    excluded=EXCLUDED_DIRECTORIES,
) -> DataFrame:
    """``path, error`` of what a scan of the same paths cannot read: missing, unreadable or too large for one cell."""
    raw = raw_files(spark, paths, recursive, tuple(suffixes), tuple(excluded))
    return raw.where("error IS NOT NULL").select("path", "error")


def scan_table(paths: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Files named by a table's column ``path``, as many as it has, each read where a task finds it; ``suffixes`` None
    takes every name. What cannot be read is in ``scan_table_errors``."""
    files = files_from_table(table_files(paths).where("error IS NULL"), F.col("path"), decode(F.col("content")))
    return files if suffixes is None else supported(files, suffixes)


def scan_table_errors(paths: DataFrame) -> DataFrame:
    """``path, error`` for every path of the table that cannot be read."""
    return table_files(paths).where("error IS NOT NULL").select("path", "error")


def only_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Keep the files named in a table of paths. The planner picks the join: the list is
    broadcast only when its measured size allows it."""
    return files.join(paths.select("path"), "path", "left_semi").select(*files.columns)


def union_files(*files: DataFrame) -> DataFrame:
    """Several file tables as one, every path once."""
    return reduce(DataFrame.unionByName, files).dropDuplicates(["path"])


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line: ``file_id, path, ext, line_number, line, stripped, indent``."""
    from ..functions.text import indent, split_lines, strip

    rows = files.select(
        "file_id", "path", "ext",
        F.posexplode(split_lines(F.col("content"))).alias("at", "line"),
    )
    return rows.select(
        "file_id", "path", "ext", (F.col("at") + 1).alias("line_number"), "line",
        strip(F.col("line")).alias("stripped"), indent(F.col("line")).alias("indent"),
    )


def spread(files: DataFrame) -> DataFrame:
    """Deal a table of files out by file id, always: checks are far heavier than reading, and a table file of any size
    may be a single split. Scans are dealt out by path already and need no more."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism, "file_id")


# Ending → language.
LANGUAGE_OF = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript",
    "tsx": "typescript", "java": "java", "go": "go", "rs": "rust",
}


def language(path: Column) -> Column:
    """Language by the text after the last dot of the path."""
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ending), F.lit("unknown"))
