"""Sequences as strings: normal form, reverse complement, encodings, overlap and composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"
#: The dinucleotides of the composition vector.
DINUCLEOTIDES = ("GC", "CG", "TA", "AT")


def normal(c: Column) -> Column:
    return F.translate(F.upper(c), "U", "T")


def reverse_complement(c: Column) -> Column:
    """Letters other than A, C, G and T stay."""
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def occurrences(c: Column, part: str) -> Column:
    """How often ``part`` occurs without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def first_position(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, -1 if there is none."""
    return F.instr(text, part) - 1


def crops(c: Column, n: int = 30) -> tuple[Column, Column]:
    return F.left(c, F.lit(n)), F.right(c, F.lit(n))


def one_hot(c: Column, length: int = 30, lenient: bool = False) -> Column:
    """Flat one-hot array, four numbers a position, zeros past the end.

    Strict: other letters are all zero. Lenient: case is ignored, U is T, and other letters are taken for A.
    """
    text = normal(c) if lenient else c

    def of(j):
        letter = F.substring(text, j, 1)
        known = letter.isin(*LETTERS) if lenient else None
        code = F.when(known, letter).when(F.length(letter) > 0, "A").otherwise("") if lenient else letter
        return F.transform(F.array(*[F.lit(x) for x in LETTERS]), lambda b: (b == code).cast("int"))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), of))


def overlap(left: Column, right: Column, longest: int) -> Column:
    """Length of the longest suffix of ``left`` that is a prefix of ``right``."""
    fits = lambda k: (F.right(left, k) == F.left(right, k)) & (k <= F.length(left)) & (k <= F.length(right))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(longest)), fits)), F.lit(0))


def composition(c: Column) -> Column:
    """Shares of the four letters, of G and C together, and of four dinucleotides (nine numbers); 0 where there are no letters,
    or no two."""
    n = F.greatest(F.length(c), F.lit(1))
    single = [occurrences(c, x) / n for x in LETTERS]
    return F.array(*single, (occurrences(c, "G") + occurrences(c, "C")) / n, *[occurrences(c, d) / F.greatest(n - 1, F.lit(1)) for d in DINUCLEOTIDES])
