"""Hash scores, roundings and accession names as Column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_score(seed, purpose: str, value: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of seed:purpose:value; its order is that of the digest's bytes."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), value.cast("string")), 256)


def seed_from_hash(digest: Column) -> Column:
    """The digest's first eight bytes as an unsigned big-endian number (decimal(20,0))."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def _two_product(a: Column, b: float) -> tuple[Column, Column]:
    """a * b as a double and the exact rest, by splitting the factors into halves (Dekker)."""
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    product, high = a * b, split(a)
    b_high = b * 134217729.0 - (b * 134217729.0 - b)
    low, b_low = a - high, b - b_high
    return product, low * b_low - (((product - high * b_high) - low * b_high) - high * b_low)


def python_round(x: Column, digits: int) -> Column:
    """Python's round(): to the nearest decimal of the exact binary value, halves to even; digits from 0 to 12.

    The scaled value is kept exactly, as a double and its rest, so a half is told from what is near one. What is left is one correctly
    rounded division, or, where the scaled value has more than 53 bits, the reading of its decimal digits.
    """
    if not 0 <= digits <= 12:
        raise ValueError("digits must be from 0 to 12")
    x = x.cast("double")
    size = F.abs(x)
    scaled, rest = _two_product(size, float(10**digits))
    whole = F.floor(scaled).cast("double")
    over = (scaled - whole - 0.5) + rest  # its sign is exact: whether the exact value lies above, at or below the half
    near = whole + F.when((over > 0) | ((over == 0) & (F.pmod(whole, F.lit(2.0)) == 1)), 1.0).otherwise(0.0)
    high = F.floor(scaled / 4294967296.0)
    dec = lambda c: c.cast("bigint").cast("decimal(38,0)")
    digits_of = (dec(high) * F.lit(4294967296).cast("decimal(38,0)") + dec(scaled - high.cast("double") * 4294967296.0) + dec(F.rint(rest))).cast("decimal(38,0)")
    long = F.concat(digits_of.cast("string"), F.lit(f"E-{digits}")).cast("double")
    done = F.when(scaled < float(1 << 53), near / float(10**digits)).otherwise(long)
    return F.when((size >= float(1 << 52)) | (x == 0), x).when(x < 0, -done).otherwise(done)


def sql_round(x: Column | str, digits: int) -> Column:
    """The double x * 10**digits rounded, halves away from zero, over 10**digits: round() of SQL engines that round as C does. What
    becomes zero keeps its sign (Spark's own round() drops it), and so do infinities; where the product has no size, x stays."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scaled = F.abs(x) * float(10**digits)
    size = F.round(scaled) / float(10**digits)
    return F.when((x == 0) | (scaled == float("inf")), x).when(x < 0, -size).otherwise(size)


def python_text(x: Column) -> Column:
    """str(float) as Python writes it (5e-05, 10000000.0), for the edge where numbers become text."""
    @F.pandas_udf("string")
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None or pd.isna(a) else str(float(a))).astype(object)

    return text(x)


ARCHIVE_SUFFIX = "_genomic.fna.gz"


def ncbi_accession(path: Column) -> Column:
    """GCF_000001.1 of .../GCF_000001.1_genomic.fna.gz; another suffix is an error."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.endswith(name, F.lit(ARCHIVE_SUFFIX)), F.substring(name, F.lit(1), F.char_length(name) - len(ARCHIVE_SUFFIX))).otherwise(F.raise_error(F.concat(F.lit("Unexpected genome file: "), path)).cast("string"))


def gtdb_accession(accession: Column) -> Column:
    """RS_ before GCF_ accessions, GB_ before GCA_; others are an error."""
    return (
        F.when(F.startswith(accession, F.lit("GCF_")), F.concat(F.lit("RS_"), accession))
        .when(F.startswith(accession, F.lit("GCA_")), F.concat(F.lit("GB_"), accession))
        .otherwise(F.raise_error(F.concat(F.lit("Unexpected accession: "), accession)).cast("string"))
    )
