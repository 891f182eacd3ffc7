"""Archives as tables: a listing that reads central directories only, and contents for the entries that are asked for."""

from __future__ import annotations

import glob
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeframe.schemas import ENTRY

#: Largest text entry that is read, and largest entry at all; an entry whose size lies is cut off there.
TEXT_LIMIT, ENTRY_LIMIT = 5 << 20, 512 << 20


def _entries(name: str, file) -> list[tuple]:
    """Rows of ENTRY; an archive that can't be read is one row with its error."""
    try:
        with zipfile.ZipFile(file) as z:
            return [(name, k, i.filename, i.compress_size, i.file_size, i.compress_type, i.CRC, i.is_dir(), None) for k, i in enumerate(z.infolist())]
    except Exception as e:  # a damaged archive must not end the scan of the others
        return [(name, -1, None, None, None, None, None, None, f"failed to list {name}: {e}")]


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Archive]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        yield from _entries(partition.path, partition.path)


class ArchiveListing(DataSource):
    """format("archive_listing").load(glob): one task an archive, which seeks to the directory at the end of the file.

    For file systems that every executor mounts; archive_entries() reads from any store of Spark's.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_listing"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> _Reader:
        pattern = self.options["path"]
        return _Reader(sorted(glob.glob(os.path.join(pattern, "**", "*.*ar") if os.path.isdir(pattern) else pattern, recursive=True)))


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """The same rows by Spark's own file reader, which also reaches remote stores but fetches whole archives."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(_entries(name, io.BytesIO(content)), columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*ar").load(path)
    return files.select("path", "content").mapInPandas(listed, ENTRY)


def contents(wanted: DataFrame, limit: int = ENTRY_LIMIT) -> DataFrame:
    """wanted (archive, name, any more) with content binary, null and an error where an entry can't be read.

    Call it on the rows that won: an archive is opened once for each batch of its entries.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.reset_index(drop=True)
            bodies, errors = [None] * len(out), [None] * len(out)
            for archive, rows in out.groupby("archive").groups.items():
                try:
                    with zipfile.ZipFile(archive) as z:
                        for k in rows:
                            try:
                                with z.open(out.at[k, "name"]) as f:
                                    body = f.read(limit + 1)
                                bodies[k], errors[k] = (body, None) if len(body) <= limit else (None, f"larger than {limit} bytes")
                            except Exception as e:  # the entry's own damage
                                errors[k] = str(e)
                except Exception as e:  # the archive's
                    for k in rows:
                        errors[k] = errors[k] or str(e)
            yield out.assign(content=bodies, error=errors)

    schema = ", ".join(f"`{c}` {t}" for c, t in wanted.drop("error").dtypes) + ", content binary, error string"
    return wanted.drop("error").mapInPandas(fetch, schema)


def texts(wanted: DataFrame) -> DataFrame:
    """contents() as UTF-8 text, of entries of at most TEXT_LIMIT bytes."""
    read = contents(wanted, TEXT_LIMIT)
    return read.withColumn("text", F.decode("content", "UTF-8")).drop("content")


def class_entries(entries: DataFrame) -> DataFrame:
    """(archive, entry_ord, name, fqn, source) of the entries that hold a class or a source file."""
    from lodeframe.functions.names import entry_name, is_class_entry, is_source_entry

    name: Column = F.col("name")
    held = entries.filter(F.col("error").isNull() & ~F.col("is_dir") & (is_class_entry(name) | is_source_entry(name)))
    source = F.when(F.endswith(name, F.lit(".class")), "binary").otherwise("sources")
    return held.select("archive", "entry_ord", "name", entry_name(name).alias("fqn"), source.alias("source"))


def source_dir(spark: SparkSession, path: str, pruned: tuple[str, ...] = ("build", "target", "out", ".git", "node_modules")) -> DataFrame:
    """(path, text) of the source files below path, build output left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,kt}").load(path)
    kept = files.filter(~F.exists(F.split("path", "/"), lambda s: s.isin(*pruned)))
    return kept.select("path", F.decode("content", "UTF-8").alias("text"))
