"""A Spark sink of Parquet shards with exact numbers of rows: chunks-00000.parquet, chunks-00001.parquet, ... in one folder or in several.

Rows come with their dense place, so the row count of a shard, its name and its rows are known before anything is written. Rows are
shuffled once, by shard; tasks write shards one after another, each under a hidden name that the task changes to the final one when the
file is whole. A task that fails takes back what it made; on commit the driver sees names and counts only, and checks that the shards
are whole; on abort they are deleted. Paths are local or any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a row group, and tasks that write, at most.
GROUP_ROWS, MOST_TASKS = 4096, 100_000
FOLDER, SHARD, PLACE = "__folder", "__shard", "__place"


def shard_name(i: int) -> str:
    return f"chunks-{i:05d}.parquet"


def place_at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """folder, shard, rows of each file that a task made."""

    files: list[tuple[str, int, int]]


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, schema: pa.Schema, options: dict):
        self.schema, self.path, self.rows, self.folders = schema, options["path"], int(options["rows"]), json.loads(options["folders"])

    def file(self, folder: str, name: str) -> str:
        return posixpath.join(self.path, folder, name)

    def delete(self, store: fs.FileSystem, at: str) -> None:
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_file(at)

    def write_one(self, folder: str, shard: int, parts: Iterator[pa.RecordBatch]) -> int:
        """Writes one shard; its file has its name only once it is whole."""
        store, base = place_at(self.file(folder, ""))
        store.create_dir(base, recursive=True)
        hidden, final, n = posixpath.join(base, f".{shard_name(shard)}.{uuid.uuid4().hex}"), posixpath.join(base, shard_name(shard)), 0
        try:
            with pq.ParquetWriter(hidden, self.schema, filesystem=store, compression="zstd") as out:
                for p in parts:
                    n += p.num_rows
                    out.write_table(pa.Table.from_batches([p]).cast(self.schema), row_group_size=GROUP_ROWS)
            self.delete(store, final)  # of an attempt that was lost
            store.move(hidden, final)
        except BaseException:
            self.delete(store, hidden)
            raise
        return n

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str, int, int]] = []
        runs = shard_runs(batches)
        try:
            first = next(runs, None)
            while first is not None:
                key, follow = first[0], []

                def parts(first=first, key=key, follow=follow):
                    yield first[1]
                    for k, part in runs:
                        if k != key:
                            follow.append((k, part))
                            return
                        yield part

                done.append((*key, self.write_one(*key, parts())))
                first = follow[0] if follow else None
        except BaseException:
            self.take_back([Written(done)])
            raise
        return Written(done)

    def take_back(self, messages: list[Written | None]) -> None:
        for m in messages:
            for folder, shard, _ in m.files if m else []:
                store, at = place_at(self.file(folder, shard_name(shard)))
                self.delete(store, at)

    def commit(self, messages: list[Written | None]) -> None:
        """Shards must be numbered without gaps and full but for the last; a folder without rows gets one shard without rows."""
        made: dict[str, dict[int, int]] = {}
        for folder, shard, n in (f for m in messages if m for f in m.files):
            made.setdefault(folder, {})[shard] = n
        for folder, of in made.items():
            last = max(of)
            if sorted(of) != list(range(last + 1)) or any(n != self.rows for s, n in of.items() if s != last) or of[last] > self.rows:
                self.take_back(messages)
                raise ValueError(f"places aren't dense: {folder or 'the folder'} has shards of {sorted(of.items())[:5]} rows ...")
        for folder in self.folders:
            if folder not in made:
                self.write_one(folder, 0, iter([pa.RecordBatch.from_pylist([], self.schema)]))

    def abort(self, messages: list[Written | None]) -> None:
        self.take_back(messages)


def shard_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """(folder, shard) and the rows, without the three columns that place them, of each stretch of rows of one shard."""
    for b in batches:
        folders, numbers = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < b.num_rows:
            end = at + 1
            while end < b.num_rows and numbers[end] == numbers[at] and folders[end] == folders[at]:
                end += 1
            yield (folders[at], numbers[at]), b.slice(at, end - at).select(range(3, b.num_columns))
            at = end


class Shards(DataSource):
    @classmethod
    def name(cls):
        return "shards"

    def writer(self, schema, overwrite):
        from pyspark.sql.pandas.types import to_arrow_schema

        return ShardWriter(pa.schema(list(to_arrow_schema(schema))[3:]), self.options)


def write_placed(df: DataFrame, path: str, rows_per_file: int, place: Column, total: int, folder: Column | None = None, folders: tuple[str, ...] = (), columns: list[str] | None = None) -> None:
    """df's rows by their dense place from 0 (in their folder, one of folders) as shards of rows_per_file rows under path.

    total: how many rows there are, about: as many tasks write as there are shards. Rows without a place fail. columns: those to store.
    """
    spark = df.sparkSession
    spark.dataSource.register(Shards)
    known = F.coalesce(place.cast("long"), F.raise_error(F.lit("a row has no place")).cast("long"))
    rows = df.select((folder if folder is not None else F.lit("")).alias(FOLDER), F.floor(known / rows_per_file).cast("long").alias(SHARD), known.alias(PLACE), *(columns or df.columns))
    tasks = min(MOST_TASKS, max(1, -(-total // rows_per_file) + len(folders)))
    rows = rows.repartition(tasks, FOLDER, SHARD).sortWithinPartitions(FOLDER, SHARD, PLACE)
    rows.write.format("shards").options(path=path, rows=str(rows_per_file), folders=json.dumps(folders)).mode("append").save()
