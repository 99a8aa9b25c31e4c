"""Python data sources for archives: sequences in tar files, rows and texts of members, worksheets.

Every source emits ordinals, since rows of a DataFrame have no order of their own. Where an archive tells where its members lie (the
directory of a zip file, the headers of a tar file that isn't compressed as a whole), its members are dealt over partitions by bytes; a
compressed tar file can only be read from its start and is one partition, so member_bytes hands its members on as they are stored, to be
unpacked elsewhere. Paths are local or any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import hashlib
import io
import json
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GENOME_SUFFIX = ".fna.gz"


@contextmanager
def opened(path: str):
    """The file at a path or URI, for reading."""
    store, at = fs.FileSystem.from_uri(quote(path, safe="/:@")) if re.match("[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as f:
        yield f


def fasta_records(lines) -> Iterator[tuple[str, str]]:
    """(first word of the header, sequence) of each record; blank lines and text before the first header don't count."""
    name, parts = None, []
    for line in lines:
        line = line.strip()
        if not line:
            continue
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            words = line[1:].split()
            if not words:
                raise ValueError("a FASTA header has no record id")
            name, parts = words[0], []
        elif name is not None:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


class Part(InputPartition):
    """Members (place, name, offset, bytes) of an archive, or all of it."""

    def __init__(self, path: str, known: list[tuple[int, str, int, int]] | None = None):
        super().__init__(path)
        self.path, self.known = path, known


#: Stored bytes of members that make a partition, about.
PART_BYTES = 32 << 20


def member_index(path: str) -> list[tuple[int, str, int, int]] | None:
    """Place, name, offset and stored bytes of an archive's regular files; None where only reading all of it would tell."""
    if path.endswith(".zip"):
        with opened(path) as f, zipfile.ZipFile(f) as z:
            return [(i, x.filename, x.header_offset, x.compress_size) for i, x in enumerate(z.infolist()) if not x.is_dir()]
    if path.endswith(".tar"):
        with opened(path) as f, tarfile.open(fileobj=f, mode="r:") as t:
            return [(i, x.name, x.offset_data, x.size) for i, x in enumerate(t) if x.isreg() and not x.issparse()]
    return None


class ArchiveReader(DataSourceReader):
    """Partitions of the archives in the option paths (parted by line feeds); part_bytes: stored bytes that make one."""

    def __init__(self, options: dict):
        self.options = options
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.pattern = options.get("member", "*")

    def partitions(self):
        most, out = int(self.options.get("part_bytes", PART_BYTES)), []
        for p in self.paths:
            index = member_index(p)
            if index is None:
                out.append(Part(p))
                continue
            part, size = [], 0
            for m in index:
                if not fnmatch.fnmatchcase(m[1], self.pattern):
                    continue
                if part and size + m[3] > most:
                    out.append(Part(p, part))
                    part, size = [], 0
                part.append(m)
                size += m[3]
            if part:
                out.append(Part(p, part))
        return out or [Part("")]


def members(part: Part, pattern: str) -> Iterator[tuple[int, str, io.BufferedIOBase]]:
    """Place, name and stream of the part's regular files whose names match, in archive order."""
    if not part.path:
        return
    with opened(part.path) as f:
        if part.known is not None and part.path.endswith(".zip"):
            with zipfile.ZipFile(f) as z:
                infos = z.infolist()
                for i, n, _, _ in part.known:
                    with z.open(infos[i]) as m:
                        yield i, n, m
        elif part.known is not None:
            for i, n, at, size in part.known:
                yield i, n, io.BufferedReader(Stretch(f, at, size))
        else:
            with tarfile.open(fileobj=f, mode="r|*") as t:
                for i, info in enumerate(t):
                    if info.isfile() and fnmatch.fnmatchcase(info.name, pattern):
                        yield i, info.name, t.extractfile(info)


class Stretch(io.RawIOBase):
    """So many bytes of a file from an offset."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.end = file, at, at + size

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        self.file.seek(self.at)
        data = self.file.read(min(len(b), self.end - self.at))
        b[: len(data)] = data
        self.at += len(data)
        return len(data)


class Forward(io.RawIOBase):
    """A member's bytes as a stream that says it can't seek: members of streamed archives can't even be asked."""

    def __init__(self, member):
        self.member = member

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.member.read(len(b))
        b[: len(data)] = data
        return len(data)


class FastaTarReader(ArchiveReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.pattern = "*" + GENOME_SUFFIX

    def read(self, partition):
        for i, name, m in members(partition, self.pattern):
            for k, (record, sequence) in enumerate(fasta_records(io.TextIOWrapper(gzip.GzipFile(fileobj=m), "ascii"))):
                yield partition.path, name, i, record, k, sequence


class FastaTar(DataSource):
    """Records of gzipped FASTA members (*.fna.gz) of tar archives."""

    @classmethod
    def name(cls):
        return "fasta_tar"

    def schema(self):
        return "archive string, archive_path string, member_ordinal int, record_id string, record_ordinal int, sequence string"

    def reader(self, schema):
        return FastaTarReader(self.options)


class MemberRowsReader(ArchiveReader):
    def read(self, partition):
        for i, name, m in members(partition, self.pattern):
            rows = csv.reader(io.TextIOWrapper(io.BufferedReader(Forward(m)), "utf-8", newline=""), delimiter=self.options.get("sep", ","))
            for k, cells in enumerate(rows):
                yield partition.path, name, i, k, cells


class MemberRows(DataSource):
    """Rows of delimited text members of zip or tar archives: cells as text, the first row too."""

    @classmethod
    def name(cls):
        return "member_rows"

    def schema(self):
        return "archive string, member string, member_ordinal int, row_no int, cells array<string>"

    def reader(self, schema):
        return MemberRowsReader(self.options)


class MemberTextReader(ArchiveReader):
    def read(self, partition):
        for i, name, m in members(partition, self.pattern):
            yield partition.path, name, i, m.read().decode("utf-8")


class MemberText(DataSource):
    """Whole texts of members."""

    @classmethod
    def name(cls):
        return "member_text"

    def schema(self):
        return "archive string, member string, member_ordinal int, text string"

    def reader(self, schema):
        return MemberTextReader(self.options)


#: Characters of a JSON text that are read at once.
JSON_PIECE = 1 << 20
_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+)', re.S)


def json_values(read, wanted: set[str], piece: int = JSON_PIECE) -> Iterator[tuple[str, str]]:
    """(path, text) of the values that stand at the wanted paths of a JSON text, in order, while the text streams by.

    A path names the keys that lead to a value, [] for an element of an array: a.b[].c. read(n) gives the next n characters or fewer.
    What is held is a piece of the text, or the value being read if that is longer; values within wanted ones aren't looked for.
    """
    path: list[str] = []  # of the value that comes next, or is open
    kinds: list[str] = []  # { or [ of what is open
    buffer, at, end, want_key = "", 0, False, False
    caught: list[str] | None = None
    inside = 0
    more = piece
    while True:
        m = _TOKEN.match(buffer, at)
        # A token that touches the end of the buffer may go on behind it.
        if not end and (m is None or m.end() == len(buffer) and m[1] not in "{}[],:"):
            new = read(more)
            end, more = not new, more * 2 if m is None and len(buffer) - at > piece else piece
            if caught is not None:
                begun = m.start(1) if m else at
                caught.append(buffer[at:begun])
                at = begun
            buffer, at = buffer[at:] + new, 0
            continue
        if m is None:
            if buffer[at:].strip() or kinds:
                raise ValueError(f"not JSON: {buffer[at : at + 40]!r}")
            return
        token = m[1]
        if caught is not None:
            caught.append(buffer[at : m.end()])
        at = m.end()
        if token in ",:":
            want_key = token == "," and kinds[-1:] == ["{"]
            continue
        if want_key and token[0] == '"':
            path[-1], want_key = json.loads(token), False
            continue
        if token in "}]":
            if not kinds or kinds.pop() != {"}": "{", "]": "["}[token]:
                raise ValueError(f"not JSON: {token} closes nothing")
            path.pop()
            want_key = False
        else:
            here = ".".join(path).replace(".[]", "[]")
            if caught is None and here in wanted:
                caught, inside = [token], len(kinds)
            if token in "{[":
                kinds.append(token)
                path.append("" if token == "{" else "[]")
                want_key = token == "{"
                continue
        if caught is not None and len(kinds) == inside:
            yield ".".join(path).replace(".[]", "[]"), "".join(caught).strip()
            caught = None


class JsonValuesReader(ArchiveReader):
    def read(self, partition):
        wanted = set(self.options["values"].split("\n"))
        for i, name, m in members(partition, self.pattern):
            text = io.TextIOWrapper(io.BufferedReader(Forward(m)), "utf-8")
            for k, (path, value) in enumerate(json_values(text.read, wanted)):
                yield partition.path, name, i, k, path, value


class JsonValues(DataSource):
    """The values at given paths (option values, parted by line feeds) of JSON members: a row each, as text, while the member streams by."""

    @classmethod
    def name(cls):
        return "json_values"

    def schema(self):
        return "archive string, member string, member_ordinal int, ordinal int, path string, value string"

    def reader(self, schema):
        return JsonValuesReader(self.options)


#: Bytes of members that leave a task together, about.
BATCH_BYTES = 8 << 20


class MemberBytesReader(ArchiveReader):
    def read(self, partition):
        rows, size = [], 0
        for i, name, m in members(partition, self.pattern):
            rows.append((partition.path, name, i, m.read()))
            size += len(rows[-1][3])
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [], 0
        yield self.batch(rows)

    def batch(self, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.binary()))], names=["archive", "member", "member_ordinal", "content"])


class MemberBytes(DataSource):
    """Members as they are stored, compressed ones too; a member is a row, so it has to be smaller than 2 GB."""

    @classmethod
    def name(cls):
        return "member_bytes"

    def schema(self):
        return "archive string, member string, member_ordinal int, content binary"

    def reader(self, schema):
        return MemberBytesReader(self.options)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n


def cell_value(c, shared: list[str]):
    """The cached value: text, int (no point or exponent), float, bool, or None."""
    kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    return float(v.text) if re.search("[.eE]", v.text) else int(v.text)


def sheet_rows(path: str, sheet: str) -> Iterator[tuple[int, list]]:
    """Row number (from 1) and values of the rows that a worksheet stores."""
    with opened(path) as f, zipfile.ZipFile(f) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, e in ET.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == f"{_MAIN}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
        ids = {s.get("name"): s.get(_REL) for s in ET.parse(z.open("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"no worksheet {sheet} in {path}")
        target = next(r.get("Target") for r in ET.parse(z.open("xl/_rels/workbook.xml.rels")).getroot() if r.get("Id") == ids[sheet])
        number = 0
        for _, e in ET.iterparse(z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
            if e.tag != f"{_MAIN}row":
                continue
            number = int(e.get("r", number + 1))
            row: list = []
            for c in e.iter(f"{_MAIN}c"):
                at = column_number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(row) + 1
                row += [None] * (at - 1 - len(row))
                row.append(cell_value(c, shared))
            yield number, row
            e.clear()


class WorksheetReader(ArchiveReader):
    def partitions(self):
        return [Part(p) for p in self.paths]

    def read(self, partition):
        first, last = int(self.options.get("min_row", 1)), int(self.options.get("max_row", 1 << 30))
        lo, hi = int(self.options.get("min_col", 1)), int(self.options.get("max_col", 1 << 30))
        for number, row in sheet_rows(partition.path, self.options["sheet"]):
            if first <= number <= last:
                part = row[lo - 1 : hi]
                yield partition.path, number - first, [None if v is None else str(v) for v in part], [isinstance(v, (int, float)) and not isinstance(v, bool) for v in part]


class Worksheet(DataSource):
    """Values of one worksheet: row_no from 0 at min_row; cells as Python writes them, and which of them are numbers."""

    @classmethod
    def name(cls):
        return "worksheet"

    def schema(self):
        return "workbook string, row_no int, cells array<string>, is_number array<boolean>"

    def reader(self, schema):
        return WorksheetReader(self.options)


class FileDigestReader(ArchiveReader):
    """A partition per file; files are read piece by piece."""

    def partitions(self):
        return [Part(p) for p in self.paths] or [Part("")]

    def read(self, partition):
        if not partition.path:
            return
        digest, size = hashlib.sha256(), 0
        with opened(partition.path) as f:
            while piece := f.read(BATCH_BYTES):
                digest.update(piece)
                size += len(piece)
        yield partition.path, digest.hexdigest(), size


class FileDigests(DataSource):
    """SHA-256 and size of whole files of any size."""

    @classmethod
    def name(cls):
        return "file_digests"

    def schema(self):
        return "file string, sha256 string, size long"

    def reader(self, schema):
        return FileDigestReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (FastaTar, FileDigests, JsonValues, MemberBytes, MemberRows, MemberText, Worksheet):
        spark.dataSource.register(source)


def load(spark: SparkSession, kind: str, paths: str | list[str], **options) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(paths="\n".join([paths] if isinstance(paths, str) else paths), **{k: str(v) for k, v in options.items()}).load()


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, sha256, size of files, each read piece by piece."""
    return load(spark, "file_digests", paths)


def first_genomes(records: DataFrame, n: int) -> DataFrame:
    """Records of the first n members in archive order."""
    chosen = records.select("archive", "member_ordinal").distinct().orderBy("archive", "member_ordinal").limit(n)
    return records.join(chosen, ["archive", "member_ordinal"], "left_semi")


def named(rows: DataFrame, header_row: int = 0, only: list[str] | None = None) -> DataFrame:
    """Rows after the header row with a text column for each header; reads one row ahead to learn the headers."""
    head = rows.filter(F.col("row_no") == header_row).first()
    if head is None:
        raise ValueError("the header row is missing")
    at = {str(n): i for i, n in enumerate(head["cells"])}
    keep = [c for c in rows.columns if c not in ("cells", "is_number")]
    names = only or [n for n in at if n and n != "None"]
    return rows.filter(F.col("row_no") > header_row).select(*keep, *[F.get("cells", F.lit(at[n])).alias(n) for n in names])


def reference_fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_id (the whole header), sequence (upper case), ordinal of plain FASTA; of equal headers the last counts."""
    from helixframe.functions.dna import ascii_upper

    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split(F.concat(F.lit("\n"), F.col("value")), r"\n[ \t]*>"), lambda x: x), lambda x, i: i > 0)).alias("ordinal", "record"))
    lines = F.transform(F.split("record", r"\r\n|\r|\n"), lambda s: F.trim(s))
    rows = text.select("ordinal", lines.alias("l")).select("ordinal", F.col("l")[0].alias("record_id"), ascii_upper(F.array_join(F.slice("l", 2, 1 << 30), "")).alias("sequence"))
    return rows.groupBy("record_id").agg(F.max_by("sequence", "ordinal").alias("sequence"), F.min("ordinal").alias("ordinal"))


def taxonomy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """gtdb_accession and seven ranks of (gzipped) accession<TAB>d__..;p__.. files; later files and lines win.

    An unknown or missing rank fails.
    """
    ranks = {"d": "domain", "p": "phylum", "c": "class", "o": "order", "f": "family", "g": "genus", "s": "species"}
    parts = []
    for i, p in enumerate(paths):
        rows = spark.read.csv(p, sep="\t", schema="gtdb_accession string, lineage string", quote="").withColumn("line", F.monotonically_increasing_id())
        parts.append(rows.withColumn("file_no", F.lit(i)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    one = rows.groupBy("gtdb_accession").agg(F.max_by("lineage", F.struct("file_no", "line")).alias("lineage"))
    taxa = F.str_to_map("lineage", F.lit(";"), F.lit("__"))
    good = F.array_sort(F.map_keys(taxa)) == F.array(*map(F.lit, sorted(ranks)))
    taxa = F.when(good, taxa).otherwise(F.raise_error(F.concat(F.lit("Unexpected taxonomy: "), F.col("lineage"))).cast("map<string,string>"))
    return one.withColumn("taxa", taxa).select("gtdb_accession", *[F.col("taxa")[k].alias(v) for k, v in ranks.items()])


def chunk_shards(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of the chunks-*.parquet that sinks.write_shards() leaves, with stored order (file_name, row_index); no shards fail."""
    df = spark.read.option("pathGlobFilter", "chunks-*.parquet").parquet(folder)
    meta = [F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index")]
    return df.select(*(columns or df.columns), *meta)


def training_sequences(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The sequences of one split, nothing else read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{split}").select("sequence")
