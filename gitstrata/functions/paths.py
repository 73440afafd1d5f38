"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.rules import languages


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: str | Column) -> Column:
    """Lower-case suffix with its dot; empty for dot files and bare names."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


def directory(path: str | Column) -> Column:
    """Directory of the file, ``root`` at the top."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", "root").otherwise(folder)


def top_directory(path: str | Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("root")


def depth(path: str | Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("long")


def with_language(df: DataFrame, view: str = "commit", path: str = "file_path", out: str = "language") -> DataFrame:
    """Language by suffix. The suffix table is fixed (under 200 rows), so it is broadcast."""
    table = df.sparkSession.createDataFrame(languages.suffix_rows(view), f"_suffix string, {out} string")
    default = languages.MAPS[view][1]
    return (
        df.withColumn("_suffix", suffix(path))
        .join(F.broadcast(table), "_suffix", "left")
        .withColumn(out, F.coalesce(out, F.lit(default)))
        .drop("_suffix")
    )


def is_skipped(path: str | Column) -> Column:
    return F.col(path).rlike("(?i)" + "|".join(languages.SKIPPED_PATHS)) if isinstance(path, str) else path.rlike(
        "(?i)" + "|".join(languages.SKIPPED_PATHS)
    )


def is_scanned(path: str | Column) -> Column:
    return suffix(path).isin(languages.SCANNED)


def is_code(path: str | Column) -> Column:
    return suffix(path).isin(languages.CODE)


def is_analyzable(path: str | Column) -> Column:
    """A file that a snapshot covers, by suffix or by whole name."""
    return suffix(path).isin(languages.SNAPSHOT_SOURCE + languages.SNAPSHOT_CONFIG) | F.lower(file_name(path)).isin(
        languages.SNAPSHOT_NAMES
    )


def in_skipped_directory(path: str | Column, view: str = "snapshot") -> Column:
    """Inside a directory that the walk leaves out (hidden ones too for a snapshot)."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    if view == "architecture":
        return F.exists(folders, lambda d: d.isin(languages.ARCHITECTURE_SKIPPED_DIRS))
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(languages.SNAPSHOT_SKIPPED_DIRS))
