"""Scan of a source tree: names are listed on the driver, files are read by the executors.

Spark's own file source hides names that begin with ``_`` or ``.``, among them package files, so the
tree is walked here. Directories are pruned while walking.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import LANGUAGES

MAX_FILE_BYTES = 1_500_000
#: Files that one read task takes, about.
FILES_PER_TASK = 256
INDEX_DIR = ".lodestrata"
# Directories without source of their own.
EXCLUDED_DIRS = {
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv",
    "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".idea",
    ".vscode", "target", ".next", ".terraform", "vendor",
    "site-packages", ".eggs",
}
# Extensions of binary files, which are never read.
BINARY_EXTENSIONS = {
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".tar", ".gz",
    ".whl", ".so", ".dylib", ".dll", ".exe", ".bin", ".pyc", ".class",
    ".jar", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".sqlite",
    ".db", ".parquet", ".npy", ".npz", ".onnx", ".pt", ".lock",
}


def detect_language(path: str) -> str | None:
    ext = os.path.splitext(path)[1].lower()
    return None if ext in BINARY_EXTENSIONS else LANGUAGES.get(ext)


def ignore_patterns(root: str) -> list[str]:
    """Patterns of the root's ignore file; negation and nested files are not supported."""
    path = os.path.join(root, ".gitignore")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        rows = [line.strip() for line in f]
    return [r.rstrip("/") for r in rows if r and not r.startswith("#")]


def pattern_regex(patterns: Sequence[str]) -> str:
    """One expression for all patterns, to be matched against a whole relative path.

    A pattern fits the path, the file's name, or anything below a directory that it names; ``*``
    crosses directories, and a leading slash means nothing.
    """
    parts = []
    for pattern in patterns:
        p = pattern.lstrip("/")
        body = re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"\1", fnmatch.translate(p))
        parts.append(rf"{body}|(?:.*/)?(?={body}$)[^/]*|{body}/.*|{re.escape(p)}/.*")
    return r"(?s:" + "|".join(parts) + r")" if parts else r"(?!)"


def discover(root: str, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> list[str]:
    """Relative paths of all files to be indexed, in order."""
    out = re.compile(pattern_regex([*ignore_patterns(root), *exclude]))
    only = re.compile(pattern_regex(include)) if include else None
    found = []
    for folder, below, names in os.walk(root):
        below[:] = [d for d in below if not d.startswith(".") and d not in EXCLUDED_DIRS]
        for name in names:
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            if detect_language(path) is None or out.fullmatch(path) or only and not only.fullmatch(path):
                continue
            try:
                if os.path.getsize(full) <= MAX_FILE_BYTES:
                    found.append(path)
            except OSError:
                pass
    return sorted(found)


def ignored(path_col: str, patterns: Sequence[str]):
    """The same test as a column expression, for listings that are tables."""
    return F.col(path_col).rlike("^" + pattern_regex(patterns) + "$") if patterns else F.lit(False)


def read_tree(spark: SparkSession, root: str, exclude: Sequence[str] = (), include: Sequence[str] = ()) -> DataFrame:
    """(file_path, language, content, sha1) of every file found; an unreadable one has null content."""
    root = os.path.abspath(root)
    paths = discover(root, exclude, include)
    rows = pd.DataFrame({"file_path": paths, "language": [detect_language(p) for p in paths]}, dtype="object")
    listed = spark.createDataFrame(rows, "file_path string, language string").repartition(max(1, -(-len(paths) // FILES_PER_TASK)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for path in batch["file_path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield batch.assign(content=contents)

    return listed.mapInPandas(read, "file_path string, language string, content binary").withColumn("sha1", F.sha1("content"))
