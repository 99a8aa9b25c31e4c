"""Archives that arrive in a folder, as a stream of their members."""

from __future__ import annotations

import json
import posixpath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from helixframe.sources.archives import MemberBytesReader
from helixframe.sources.shards import place_at

SUFFIXES = (".tar", ".tar.gz", ".tgz", ".zip")


class ArchiveStreamReader(DataSourceStreamReader):
    """Offsets count the entries of a log of archives, kept beside the stream's checkpoint: a name is added to it once, when it is first
    seen, so an archive is read once whatever its name or time, and a restarted stream reads the same archives for the same offsets.

    Archives must appear in one piece (written elsewhere, then moved in); names that begin with . or _ aren't looked at. At most
    most_archives of them make a batch; with an availableNow trigger Spark takes one batch of such a source, so leave it unset there.
    """

    def __init__(self, options: dict):
        self.options = options
        self.folder, self.log = options["path"], options["log"]
        self.most = int(options.get("most_archives", 1 << 30))
        self.given: int | None = None

    def known(self) -> list[str]:
        store, at = place_at(self.log)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return []
        with store.open_input_stream(at) as f:
            return json.loads(f.read())

    def seen(self) -> list[str]:
        """The log, after what is new in the folder has been added to it."""
        known = self.known()
        store, base = place_at(self.folder)
        found = [x.path for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and x.base_name.endswith(SUFFIXES) and x.base_name[0] not in "._"]
        prefix = self.folder[: len(self.folder) - len(base)] if self.folder.endswith(base) else ""
        new = sorted({prefix + p for p in found} - set(known))
        if new:
            known += new
            to, at = place_at(self.log)
            to.create_dir(posixpath.dirname(at), recursive=True)
            with to.open_output_stream(at + ".new") as f:
                f.write(json.dumps(known).encode())
            if to.type_name != "local" and to.get_file_info(at).type != fs.FileType.NotFound:
                to.delete_file(at)
            to.move(at + ".new", at)
        return known

    def initialOffset(self) -> dict:
        return {"archives": 0}

    def latestOffset(self) -> dict:
        n = len(self.seen())
        self.given = min(n, (self.given or 0) + self.most)
        return {"archives": self.given}

    def partitions(self, start: dict, end: dict):
        self.given = max(self.given or 0, end["archives"])
        return MemberBytesReader({**self.options, "paths": "\n".join(self.known()[start["archives"] : end["archives"]])}).partitions()

    def read(self, partition):
        return MemberBytesReader({**self.options, "paths": ""}).read(partition)

    def commit(self, end: dict) -> None:
        """The log stays: a restarted stream counts on it."""


class ArchiveFolder(DataSource):
    """Members, as they are stored, of the archives in a folder (options path, log, member, most_archives)."""

    @classmethod
    def name(cls):
        return "archive_folder"

    def schema(self):
        return "archive string, member string, member_ordinal int, content binary"

    def streamReader(self, schema):
        return ArchiveStreamReader(self.options)


def arriving(spark: SparkSession, folder: str, log: str, member: str = "*", most_archives: int | None = None) -> DataFrame:
    """A stream of the members of archives in folder, old and new ones."""
    spark.dataSource.register(ArchiveFolder)
    options = {"path": folder.rstrip("/"), "log": log, "member": member} | ({} if most_archives is None else {"most_archives": str(most_archives)})
    return spark.readStream.format("archive_folder").options(**options).load()
