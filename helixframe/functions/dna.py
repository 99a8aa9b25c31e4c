"""Column functions over DNA text; a precondition that fails raises an error.

What looks at each base of long texts runs on Arrow batches as NumPy arrays; the rest stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.batches import bounded, flat, texts

BASES = "ACGT"
# The standard genetic code, codons in TCAG order, stop as *.
CODE_ORDER = "TCAG"
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: RESIDUES[16 * i + 4 * j + k] for i, a in enumerate(CODE_ORDER) for j, b in enumerate(CODE_ORDER) for k, c in enumerate(CODE_ORDER)}

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use and its lambdas read it."""
    return F.transform(F.array(value), use)[0]


def ascii_upper(s: Column) -> Column:
    """a-z to A-Z and nothing else, so that offsets stay."""
    return F.translate(s, _LOWER, _UPPER)


def codon_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])


#: A byte's base in either case as its place in CODE_ORDER; 4: no base.
_PLACE = np.array([CODE_ORDER.find(chr(c).upper()) % 5 if c < 128 else 4 for c in range(256)], np.uint8)


def _residues(s: Column) -> Column:
    """Residues of whole codons; null where a base isn't one or the last codon isn't whole."""
    bounded()
    place, coded = _PLACE, np.frombuffer(RESIDUES.encode(), np.uint8)

    @F.arrow_udf("string")
    def residues(s: pa.Array) -> pa.Array:
        at, data = flat(s)
        n, base = np.diff(at), place[data]
        good = n % 3 == 0
        if (base > 3).any():
            wrong = np.concatenate([[0], np.cumsum(base > 3)])
            good &= wrong[at[1:]] == wrong[at[:-1]]
        if not good.all():
            base, n = base[np.repeat(good, n)], np.where(good, n, 0)
        return texts(coded[16 * base[0::3] + 4 * base[1::3] + base[2::3]], n // 3, pa.array(good))

    return residues(s)


def translate_dna(s: Column) -> Column:
    """Residues of a coding sequence in either case; its length must be a multiple of three, its bases A, C, G, T."""
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(F.char_length(s) % 3 != 0, F.raise_error(F.concat(F.lit("whole codons are needed, but the length is "), F.char_length(s).cast("string"))))
        .otherwise(F.coalesce(_residues(s), F.raise_error(F.concat(F.lit("Unsupported codon in "), ascii_upper(s))).cast("string")))
    )


def difference_ends(a: Column, b: Column) -> Column:
    """struct<first, last, first_back, last_back>: places from 0 of the first and last difference of two strings, told from their
    beginnings, and from their ends backwards; null where there is none. Of strings of unequal length the shorter one's length counts."""
    bounded()
    names = ("first", "last", "first_back", "last_back")

    @F.arrow_udf(", ".join(f"{n} int" for n in names))
    def ends(a: pa.Array, b: pa.Array) -> pa.Array:
        (starts, x), (others, y) = flat(a), flat(b)
        out = []
        for i in range(len(a)):
            u, v = x[starts[i] : starts[i + 1]], y[others[i] : others[i + 1]]
            if len(u) and len(v) and max(u.max(), v.max()) >= 128:
                u, v = (np.frombuffer(t.tobytes().decode().encode("utf-32-le"), np.uint32) for t in (u, v))
            n = min(len(u), len(v))
            at = np.flatnonzero(u[:n] != v[:n])
            back = at if len(u) == len(v) else np.flatnonzero(u[len(u) - n :] != v[len(v) - n :])
            out.append((at[0], at[-1]) if len(at) else (None, None))
            out[-1] += (n - 1 - back[-1], n - 1 - back[0]) if len(back) else (None, None)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], pa.int32()) for k in range(4)], names=list(names))

    return ends(a, b)


def replace_codon(s: Column, position: Column, codon: Column) -> Column:
    """s with the codon at a 1-based position replaced (in upper case)."""
    up = ascii_upper(codon)
    position = position.cast("int")
    return (
        F.when(s.isNull() | position.isNull() | codon.isNull(), F.lit(None).cast("string"))
        .when((position < 1) | (position * 3 > F.char_length(s)), F.raise_error(F.concat(F.lit("Codon position outside the sequence: "), position.cast("string"))))
        .when(~F.rlike(up, F.lit(r"\A[ACGT]{3}\z")), F.raise_error(F.concat(F.lit("three of A, C, G and T make a codon, not "), codon)))
        .otherwise(F.concat(F.substring(s, F.lit(1), (position - 1) * 3), up, F.substring(s, position * 3 + 1, F.char_length(s))))
    )


def _listed(a: Column, b: Column, order: str, none: str, one: tuple[str, str], several: tuple[str, str], comma: str, upper: bool = False) -> Column:
    """Where strings of one length differ, in words: each place as position (from 1), x and y put into order, all joined and put between
    the two parts of one or several; none if there is no place. upper: a to z count as A to Z."""
    bounded()
    case = np.arange(256, dtype=np.uint8)
    if upper:
        case[97:123] -= 32

    @F.arrow_udf("string")
    def listed(a: pa.Array, b: pa.Array) -> pa.Array:
        ends, out = (flat(a), flat(b)), []
        for i in range(len(a)):  # a text at a time, so that few places are held
            u, v = (case[x[at[i] : at[i + 1]]] for at, x in ends)
            if len(u) and len(v) and max(u.max(), v.max()) >= 128:
                u, v = (np.frombuffer(t.tobytes().decode().encode("utf-32-le"), np.uint32) for t in (u, v))
            places = np.flatnonzero(u != v) if len(u) == len(v) else np.empty(0, np.int64)
            if not len(places):
                out.append(none)
                continue
            letter = lambda x: pa.array(np.ascontiguousarray(x[places], np.uint32).view("U1"), pa.string())  # noqa: B023, E731
            parts = {"i": pc.cast(pa.array(places + 1), pa.string()), "x": letter(u), "y": letter(v)}
            words = pc.binary_join_element_wise(*[parts.get(c, c) for c in order], "")
            before, after = one if len(places) == 1 else several
            out.append(before + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), comma)[0].as_py() + after)
        return pa.array(out, pa.string())

    return listed(a, b)


def _by_length(wt: Column, mutant: Column, same: Column) -> Column:
    return F.when(F.char_length(mutant) > F.char_length(wt), F.lit("insertion")).when(F.char_length(mutant) < F.char_length(wt), F.lit("deletion")).when(wt.isNotNull() & mutant.isNotNull(), same)


def describe_coding_edit(wt: Column, mutant: Column) -> Column:
    """c.=, c.6T>C, c.[4G>T;6T>G], insertion or deletion (by length)."""
    return _by_length(wt, mutant, _listed(wt, mutant, "ix>y", "c.=", ("c.", ""), ("c.[", "]"), ";", upper=True))


def describe_residue_changes(wt: Column, mutant: Column) -> Column:
    """p.=, M1I:A2V, insertion or deletion (by length)."""
    return _by_length(wt, mutant, _listed(wt, mutant, "xiy", "p.=", ("", ""), ("", ""), ":"))


def reverse_complement(s: Column) -> Column:
    """A and T, C and G swapped, then reversed; other characters stay."""
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def apply_substitutions(s: Column, mutation: Column) -> Column:
    """s with A1G_T6C applied in turn; each base that is replaced must be as written."""
    part = r"\A([ACGT])(\d+)([ACGT])\z"

    def step(acc: Column, m: Column) -> Column:
        at = F.regexp_extract(m, part, 2).try_cast("int")
        fits = F.rlike(m, F.lit(part)) & (F.substring(acc, at, F.lit(1)) == F.regexp_extract(m, part, 1))
        return F.when(F.coalesce(fits, F.lit(False)), F.overlay(acc, F.regexp_extract(m, part, 3), at, F.lit(1))).otherwise(F.raise_error(F.concat(F.lit("Unsupported or mismatched substitution: "), m)).cast("string"))

    return F.when(s.isNotNull() & mutation.isNotNull(), F.aggregate(F.split(mutation, "_"), s, step))


def segments(s: Column, most: int | None = None) -> Column:
    """array<struct<start long, sequence>> of the maximal runs of A, C, G, T in upper-case text, starts from 0; with most, cut into pieces of so many."""
    runs = F.regexp_extract_all(s, F.lit(f"[ACGT]{{1,{int(most)}}}|[^ACGT]+" if most else "[ACGT]+|[^ACGT]+"), F.lit(0))

    def placed(r: Column) -> Column:
        starts = running_starts(F.transform(r, lambda x: F.char_length(x).cast("long")))
        return F.filter(F.arrays_zip(starts.alias("start"), r.alias("sequence")), lambda x: F.substring(x["sequence"], 1, 1).isin(*BASES))

    return let(runs, placed)


def running_starts(lengths: Column, run: int = 32) -> Column:
    """array<long>: for each entry the sum of those before it.

    Entries are summed within runs and runs of runs, so that only arrays of up to `run` entries, or of a
    thousandth of all, grow one by one.
    """
    def runs(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / run).cast("int")), lambda i: F.slice(all_, i * run + 1, run))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, n: s + n)
    small = lambda part: F.aggregate(part, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def level(starts: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """Starts of an array, where starts() gives those of its runs' totals."""
        def placed(parts: Column) -> Column:
            return let(starts(F.transform(parts, total)), lambda before: F.flatten(F.transform(parts, lambda part, i: F.transform(small(part), lambda x: x + before[i]))))

        return lambda all_: let(runs(all_), placed)

    return let(lengths, level(level(small)))


def windows(s: Column, length: int) -> Column:
    """array<string> of consecutive pieces of length, the last one shorter if need be; read once from left to right."""
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{int(length)}}}"), F.lit(0))


def _base_id(b: Column) -> Column:
    return F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).cast("long")


def tokens(s: Column) -> Column:
    """array<long>: A, C, G, T as 0 to 3; anything else, lower case too, is an error."""
    ids = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), _base_id)
    return F.when(s.isNull(), F.lit(None).cast("array<long>")).when(~F.rlike(s, F.lit(r"\A[ACGT]*\z")), F.raise_error(F.concat(F.lit("Unsupported base in "), s))).otherwise(ids)
