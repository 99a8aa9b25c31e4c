"""From sequence records to fixed-length chunks, their statistics, and training windows."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from helixframe.functions import dna, ranges, scores
from helixframe.sources.archives import fasta_records

CHUNK = 8192


#: Pieces, and bytes of pieces, that leave a task in one Arrow batch, about.
PIECES, PIECE_BYTES = 50_000, 32 << 20


def chunks(records: DataFrame, length: int = CHUNK, sequence_col: str = "sequence") -> DataFrame:
    """records' unambiguous runs cut into pieces of length: chunk_start, chunk_end (0-based half-open in the record), chunk_length, sequence.

    One regular expression finds the pieces with their places. That is done on Arrow batches: column functions tell no places,
    and summing lengths up to each piece takes several times as long.
    """
    keep = [c for c in records.columns if c != sequence_col]
    names = [*keep, "record_length", "chunk_start", "chunk_end", "chunk_length", "sequence"]
    rows = records.select(*keep, F.char_length(sequence_col).cast("long").alias("record_length"), dna.ascii_upper(F.col(sequence_col)).alias("sequence"))
    piece, most = re.compile(f"[ACGT]{{1,{int(length)}}}"), PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            found = ((at, m.start(), m[0]) for at in range(b.num_rows) for m in piece.finditer(column[at].as_py() or ""))
            while some := list(islice(found, most)):
                rows, starts, texts = (pa.array(x) for x in zip(*some))
                n = pc.utf8_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*b.select(names[:-4]).take(rows).columns, starts, pc.add(starts, n), n, texts], names=names)

    long = lambda name: StructField(name, LongType())
    schema = StructType([*rows.schema.fields[:-1], long("chunk_start"), long("chunk_end"), long("chunk_length"), StructField("sequence", StringType())])
    return rows.mapInArrow(cut, schema)


#: What member_chunks() gives: a row per piece, and one without a piece for each record that has none.
CUT = StructType([StructField(n, k) for n, k in (("archive", StringType()), ("archive_path", StringType()), ("member_ordinal", IntegerType()), ("record_id", StringType()), ("record_length", LongType()), ("chunk_start", LongType()), ("chunk_end", LongType()), ("chunk_length", LongType()), ("ordinal", LongType()), ("first", BooleanType()), ("sequence", StringType()))])


def member_chunks(members: DataFrame, length: int = CHUNK) -> DataFrame:
    """Chunks of the gzipped FASTA members (archive, member, member_ordinal, content), in CUT's columns.

    ordinal numbers a member's chunks from 0 in stored order; first is set on one row of each record. A member is unpacked piece by
    piece, wherever it was shuffled to.
    """
    piece, most, names = re.compile(f"[ACGT]{{1,{int(length)}}}"), PIECES, CUT.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(b.num_rows):
                archive, name, place = (b.column(k)[at].as_py() for k in range(3))
                lines, n = io.TextIOWrapper(gzip.GzipFile(fileobj=pa.BufferReader(b.column(3)[at].as_buffer())), "ascii"), 0
                for record, sequence in fasta_records(lines):
                    of, first = (archive, name, place, record, len(sequence)), True
                    for m in piece.finditer(sequence.upper()):
                        yield (*of, m.start(), m.end(), m.end() - m.start(), n, first, m[0])
                        n, first = n + 1, False
                    if first:
                        yield (*of, None, None, None, None, True, None)

    schema = to_arrow_schema(CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, min(most, max(1, PIECE_BYTES // length)))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some), schema)], names=names)

    return members.select("archive", "member", "member_ordinal", "content").mapInArrow(cut, CUT)


def cut_stats(cut: DataFrame, length: int = CHUNK) -> DataFrame:
    """corpus_stats' nine counters from member_chunks' rows; sequences aren't read."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    n = F.col("chunk_length")
    sums = cut.agg(
        F.count_distinct("archive_path").alias("genomes_processed"), F.count_if("first").alias("fasta_records_processed"), s(F.when(F.col("first"), F.col("record_length"))).alias("input_bases"), s(n).alias("retained_bases"),
        F.count("ordinal").alias("chunks"), F.count_if(n == length).alias("full_length_chunks"), F.count_if(n < length).alias("short_chunks"), s(F.when(n < length, n)).alias("short_chunk_bases"),
    )
    lost = (F.col("input_bases") - F.col("retained_bases")).alias("ambiguous_bases")
    return sums.select("genomes_processed", "fasta_records_processed", "input_bases", lost, "retained_bases", "chunks", "full_length_chunks", "short_chunks", "short_chunk_bases")


def genome_chunks(records: DataFrame, length: int = CHUNK) -> DataFrame:
    """Chunk rows of genome records (archive_path, record_id, sequence), in the ten columns of the stored corpus."""
    rows = records.withColumn("ncbi_accession", scores.ncbi_accession(F.col("archive_path"))).withColumn("gtdb_accession", scores.gtdb_accession(F.col("ncbi_accession")))
    return named_chunks(chunks(rows, length))


def named_chunks(rows: DataFrame, *more: Column) -> DataFrame:
    """Chunk rows with their accessions in the ten columns of the stored corpus, and more after them."""
    name = F.concat(F.col("gtdb_accession"), F.lit("|"), F.col("record_id"), F.lit("|"), F.col("chunk_start").cast("string"), F.lit("-"), F.col("chunk_end").cast("string"))
    return rows.select(name.alias("chunk_id"), "ncbi_accession", "gtdb_accession", "archive_path", "record_id", "record_length", "chunk_start", "chunk_end", "chunk_length", "sequence", *more)


def corpus_stats(records: DataFrame, genome_col: str, length: int = CHUNK, sequence_col: str = "sequence") -> DataFrame:
    """One row of nine counters over records, those without chunks too.

    Matches of exactly length bases are the full chunks, since they start over with each run; matches of 1 to length bases
    are all chunks. Nothing else about runs is worked out.
    """
    text, zero = F.col(sequence_col), F.lit(0).cast("long")
    number = lambda most: F.coalesce(F.regexp_count(text, F.lit(f"[ACGTacgt]{{{most}}}")), zero).cast("long")
    n = F.coalesce(F.char_length(text), zero).cast("long")
    rows = records.select(F.col(genome_col).alias("genome"), n.alias("n"), (n - F.coalesce(F.char_length(F.translate(text, "ACGTacgt", "")), zero)).alias("kept"), number(length).alias("full"), number(f"1,{length}").alias("all"))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        F.count_distinct("genome").alias("genomes_processed"), F.count("*").alias("fasta_records_processed"), s("n").alias("input_bases"),
        s(F.col("n") - F.col("kept")).alias("ambiguous_bases"), s("kept").alias("retained_bases"), s("all").alias("chunks"),
        s("full").alias("full_length_chunks"), s(F.col("all") - F.col("full")).alias("short_chunks"), s(F.col("kept") - F.col("full") * length).alias("short_chunk_bases"),
    )


def full_chunk_counts(rows: DataFrame, genome_col: str, is_full: Column) -> DataFrame:
    """genome, full chunks of each genome, those without any included; one partial and one final aggregate."""
    return rows.groupBy(genome_col).agg(F.count_if(F.coalesce(is_full, F.lit(False))).alias("full_chunks"))


def sequence_windows(rows: DataFrame, length: int, sequence_col: str = "sequence") -> DataFrame:
    """rows with window_no and window: the sequence's consecutive pieces, the tail kept."""
    keep = [c for c in rows.columns if c != sequence_col]
    return rows.select(*keep, F.posexplode(dna.windows(F.col(sequence_col), length)).alias("window_no", "window"))


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """rows in a random order that depends on seed and key alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def rank_split(rows: DataFrame, world_size: int, rank: int, *key: str) -> DataFrame:
    """The share of rows of one of world_size ranks: disjoint, exhaustive, the same on every run; no shuffle."""
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(world_size)) == rank)


def dealt(rows: DataFrame, world_size: int, order: str) -> DataFrame:
    """rows with rank = place in order modulo world_size, for an order that is a dense number from 0 or 1."""
    return rows.withColumn("rank", F.pmod(F.col(order), F.lit(world_size)).cast("int"))


#: Keys that rows with one frequent value are dealt over where rows are numbered.
DEALT = 64


def with_place(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """rows with their dense place from 0 in the order of a number; equal ones in any order, nulls last.

    Ranges between quantiles are counted and summed; a task orders one of them. A value that many rows have is a quantile: such rows are
    dealt over keys of their own, so that no task numbers all of them.
    """
    known = ranges.bounds(rows, order)[0]
    cut = rows.withColumn("__range", F.coalesce(ranges.place(known, F.col(order)), F.lit(ranges.RANGES)))
    many = F.col(order).isNull() | (F.col(order).isin(known) if known else F.lit(False))
    cut = cut.withColumn("__deal", F.when(many, F.pmod(F.xxhash64(*rows.columns), F.lit(DEALT))).otherwise(DEALT).cast("int"))
    before = Window.orderBy("__range", "__deal").rowsBetween(Window.unboundedPreceding, -1)  # 257 * 65 rows at most
    starts = cut.groupBy("__range", "__deal").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__range", "__deal").orderBy(F.col(order).asc_nulls_last())
    return cut.join(F.broadcast(starts), ["__range", "__deal"]).withColumn(name, (F.col("__start") + F.row_number().over(inside) - 1).cast("long")).drop("__range", "__start", "__deal")


#: Rounds of the permutation, and walks back into its domain before it gives up (each fails with a chance below a half).
ROUNDS, WALKS = 6, 64


def permuted(place: Column, n: int, seed: int) -> Column:
    """A bijection of 0 .. n - 1 that depends on the seed: a Feistel network on the bits that n needs, walked until it is within.

    Each number's place is worked out by itself, so an order of any number of rows needs neither a sort nor a shuffle.
    """
    bits = max(2, (max(n, 1) - 1).bit_length())
    low = bits // 2
    high = bits - low

    def network(x: Column) -> Column:
        """Halves of high and low bits; odd rounds change the one, even rounds the other, by a hash of the half that stays."""
        pair = F.struct(F.shiftrightunsigned(x, low).alias("a"), x.bitwiseAND((1 << low) - 1).alias("b"))

        def turn(p: Column, r: Column) -> Column:
            keyed = lambda half, width: F.xxhash64(F.lit(seed), r, half).bitwiseAND((1 << width) - 1)
            even = r % 2 == 0
            return F.struct(F.when(even, p["a"].bitwiseXOR(keyed(p["b"], high))).otherwise(p["a"]).alias("a"), F.when(even, p["b"]).otherwise(p["b"].bitwiseXOR(keyed(p["a"], low))).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turn, lambda p: F.shiftleft(p["a"], low).bitwiseOR(p["b"]))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place in the permutation: take another seed")).cast("long"))


def numbered_windows(rows: DataFrame, window: int, sequence_col: str = "sequence") -> tuple[DataFrame, int]:
    """(place, window) of the whole windows of every sequence, place dense from 0, and how many there are.

    Partitions' windows are counted first (a row per partition); within a partition they are numbered as they pass. rows should be a
    table: it is read twice and must come in the same partitions.
    """
    rows = rows.select(F.col(sequence_col).alias("sequence"))
    part = rows.select(F.spark_partition_id().alias("part"), F.floor(F.char_length("sequence") / window).cast("long").alias("n"))
    counts = {r["part"]: r["n"] for r in part.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p], total = total, total + (counts[p] or 0)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = starts.get(TaskContext.get().partitionId(), 0)
        most = max(1, PIECE_BYTES // window)
        found = (s[i : i + window] for b in batches for s in b.column(0).to_pylist() if s for i in range(0, len(s) - window + 1, window))
        while some := list(islice(found, most)):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], names=["place", "window"])
            at += len(some)

    return rows.mapInArrow(number, "place long, window string"), total


def training_batches(rows: DataFrame, window: int, batch: int, seed: int, world_size: int = 1, rank: int = 0, sequence_col: str = "sequence") -> DataFrame:
    """batch_no, input_ids: a rank's batches of windows of stored sequences (one column), shuffled by seed.

    Every window goes to one rank; the tail of a sequence that is shorter than a window is left out, and so are a rank's last
    windows that don't fill a batch. A keyed permutation of the windows' places gives each its rank, batch and place in the batch:
    nothing is sorted, and equal windows are as good as any. The only shuffle brings the rows of a batch together.
    """
    cut, total = numbered_windows(rows, window, sequence_col)
    cut = cut.select("window", permuted(F.col("place"), total, seed).alias("__p"))
    mine = cut.filter(F.col("__p") % world_size == rank).select("window", F.floor(F.col("__p") / world_size).cast("long").alias("place"))
    whole = (total - rank + world_size - 1) // world_size // batch * batch
    return token_batches(mine.filter(F.col("place") < whole), batch, "place")


def first_batches(batches: DataFrame, n: int) -> DataFrame:
    """The first n of token_batches' rows."""
    return batches.filter(F.col("batch_no") < n)


def replicate_mean(one: DataFrame, two: DataFrame, key: str, value: str, name: str = "score") -> DataFrame:
    """key and the mean of the two replicates' values. A key that either replicate lacks fails."""
    both = one.select(key, F.col(value).alias("__a")).join(two.select(key, F.col(value).alias("__b")), key, "full")
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(key, F.when(known, (F.col("__a") + F.col("__b")) / 2).otherwise(F.raise_error(F.concat(F.lit("a replicate lacks "), F.col(key).cast("string"))).cast("double")).alias(name))


def token_batches(rows: DataFrame, batch: int, position: str, sequence_col: str = "window") -> DataFrame:
    """batch_no, input_ids: token ids of batch rows each by position (from 0); rows of one batch must be equally long.

    Sequences are shuffled as text and become ids, eight bytes a base, behind the shuffle.
    """
    cut = rows.select(F.floor(F.col(position) / batch).alias("batch_no"), F.struct(F.col(position).alias("p"), F.col(sequence_col).alias("s")).alias("x"))
    out = cut.groupBy("batch_no").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    same = F.forall("xs", lambda x: F.char_length(x["s"]) == F.char_length(F.col("xs")[0]["s"]))
    return out.select("batch_no", F.when(same, F.transform("xs", lambda x: dna.tokens(x["s"]))).otherwise(F.raise_error(F.lit("sequences of one batch differ in length"))).alias("input_ids"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def first_seen_index(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """key, first_ordinal, position: keys numbered from 1 by their first ordinal (as many rows as there are keys)."""
    first = rows.groupBy(key).agg(F.min(ordinal).alias("first_ordinal"))
    return first.withColumn("position", F.row_number().over(Window.orderBy("first_ordinal", key)))


def concatenated(rows: DataFrame, keys: list[str], position: str, ordinal: str, value: str) -> DataFrame:
    """keys, joined: the first value (by ordinal) at each position, in position order, put together; n_variants: positions with differing values."""
    first = rows.groupBy(*keys, position).agg(F.min_by(value, ordinal).alias("v"), F.count_distinct(value).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(position, "v"))), lambda x: x["v"])
    return first.groupBy(*keys).agg(F.array_join(parts, "").alias("joined"), F.count_if(F.col("n") > 1).alias("n_variants"))


def unpivoted(rows: DataFrame, ids: list[str], columns: list[str], name: str = "position", value: str = "score") -> DataFrame:
    return rows.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())
