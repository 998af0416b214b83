"""File sources: directories, single files and globs, with the filters of the directory walk."""

from __future__ import annotations

import fnmatch
import glob as globbing
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loamdex.functions.text import extension, file_name

# Extensions of indexed files; directories never entered (besides those whose names start with a dot); extensions of code.
EXTENSIONS = "md txt rs toml yaml yml json py js ts tsx jsx sh css html xml csv sql tf hcl conf ini cfg env".split()
SKIPPED = ".git .venv node_modules __pycache__ target dist build .next .nuxt .idea .vscode".split()
CODE_EXTENSIONS = "rs py ts tsx js jsx go java kt c cpp h cs rb swift zig lua sh bash zsh ps1 sql toml yaml yml json xml html css scss".split()


def allowed_extension(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def kept_directory(path: Column) -> Column:
    """No directory of the path is skipped by name or starts with a dot."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.exists(folders, lambda s: s.isin(SKIPPED) | s.startswith("."))


def ignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: blank lines and comments dropped, a trailing slash kept as a mark of a directory."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern matches the whole path or the file's name; * crosses slashes. One that ends in / drops all below such a directory."""
    out = F.lit(False)
    for p in patterns:
        if not p.strip() or p.startswith("#"):
            continue
        bare = p.rstrip("/")
        regex = fnmatch.translate(bare).replace(r"\Z", r"\z").replace(r"(?s:", "(?s:")
        regex = f"^{regex}" if not regex.startswith("^") else regex
        out = out | path.rlike(regex) | file_name(path).rlike(regex)
        if p.endswith("/"):
            body = re.sub(r"\\[zZ]$", "", fnmatch.translate(bare))
            out = out | path.rlike(f"(?:^|/){body}/")
    return out


def read_tree(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """(path, content, content_hash, modified) of the allowed files below a directory; path is relative to it. Hashes are of raw bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^file:/+", "/") if "://" not in root else F.col("path")
    rel = F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)
    # the walk's filters are on the path alone, so files they drop are never read
    df = raw.withColumn("rel", rel).where(allowed_extension(F.col("rel")) & kept_directory(F.col("rel")) & ~ignored(F.col("rel"), list(patterns)))
    return df.select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Single files, by their bare names; neither extensions nor ignore patterns apply."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(file_name(F.col("path")).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def read_watch_path(spark: SparkSession, path: str, patterns: list[str] = ()) -> DataFrame | None:
    """A directory, a file or a glob; None if nothing is there."""
    if os.path.isdir(path):
        if os.path.basename(path.rstrip("/")).startswith("."):
            return None
        return read_tree(spark, path, patterns) if any(f for _, _, f in os.walk(path)) else None
    if os.path.isfile(path):
        return read_files(spark, [path])
    found = [p for p in globbing.glob(path, recursive=True) if os.path.isfile(p)]
    if not found:
        return read_tree(spark, path, patterns) if "://" in path else None
    raw = spark.read.format("binaryFile").load(found)
    plain = F.regexp_replace("path", r"^file:/+", "/")
    return raw.select(plain.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def has_code(path: Column) -> Column:
    """Aggregate: whether any path is code (extensions as they are written, in lower case)."""
    return F.coalesce(F.bool_or(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1).isin(CODE_EXTENSIONS)), F.lit(False))
