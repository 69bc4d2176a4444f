"""What a store says of paths: which names are one file, and which folders are roots of repositories.

Everything is asked on the executors, a path at a time, through the store the path is in.
"""

from __future__ import annotations

import os
import posixpath

import pandas as pd
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tail import file_system


def identity(path: str) -> str:
    """One text for all names of a file: the path that links lead to; of a file with several hard links what they share.

    Devices have other numbers on other machines, so hard links are told by inode,
    size and time. A path in another kind of store, or that is gone, is itself.
    """
    try:
        store, where = file_system(path)
        if not isinstance(store, stores.LocalFileSystem):
            return path
        real = os.path.realpath(where)
        said = os.stat(real)
    except (pa.ArrowException, OSError, ValueError):
        return path
    return f"links:{said.st_ino}:{said.st_size}:{said.st_mtime_ns}" if said.st_nlink > 1 else real


def unique_sources(found: DataFrame) -> DataFrame:
    """Of files (provider, source_path, ...) that are one, that with the least path; null paths stay."""

    @F.pandas_udf("string")
    def identities(paths: pd.Series) -> pd.Series:
        return paths.map(identity, na_action="ignore")

    names = found.columns
    asked = found.withColumn("__file", identities("source_path"))
    least = asked.groupBy("provider", "__file").agg(F.min_by(F.struct(*names), "source_path").alias("__least"), F.first(F.struct(*names)).alias("__any"))
    return least.select(F.coalesce("__least", "__any").alias("s")).select("s.*")


def root_of(folder: str) -> str | None:
    """The repository whose root ``folder`` is; of a linked worktree the main one's root, a submodule is its own. None if it isn't a root."""
    try:
        store, where = file_system(folder)

        def kind(path: str) -> stores.FileType:
            return store.get_file_info(path).type

        at = posixpath.join(where, ".git")
        found = kind(at)
        if found == stores.FileType.NotFound:
            return None
        if found == stores.FileType.File:
            with store.open_input_file(at) as f:
                said = f.read(4096).decode("utf-8", "replace").strip()
            if said.startswith("gitdir: "):
                trees, _ = posixpath.split(posixpath.normpath(posixpath.join(where, said.removeprefix("gitdir: "))))
                main = posixpath.dirname(posixpath.dirname(trees))
                if posixpath.basename(trees) == "worktrees" and kind(posixpath.join(main, ".git")) != stores.FileType.NotFound:
                    return main
    except (pa.ArrowException, OSError, ValueError):
        return None
    return where


def repository_roots(sessions: DataFrame) -> DataFrame:
    """(path, root): the folders at or above the sessions' working folders that are roots; each folder is asked once."""

    @F.pandas_udf("string")
    def roots(paths: pd.Series) -> pd.Series:
        return paths.map(root_of)

    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = sessions.filter("cwd LIKE '/%'").select(F.explode(above).alias("path")).filter("path <> ''").distinct()
    return folders.withColumn("root", roots("path")).filter("root IS NOT NULL")
