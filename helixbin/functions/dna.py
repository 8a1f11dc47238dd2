"""DNA expressions: sanitising, reverse complement, masks, canonical k-mers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC codes and their complements.
CODES = "ATGCYRSWKMBDHVN"
COMPLEMENTS = "TACGRYSWMKVHDBN"
KEPT = {"strict": "[^ATGC]", "iupac": "[^ATGCYRSWKMBDHVN]"}
#: Fixed value: how letters of any text become bases, for tables without DNA.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES_OF_LETTERS = "ATGCATGCATGCATGCATGCATGCAN"


def check_mode(mode: str) -> None:
    if mode not in KEPT:
        raise ValueError(f"mode has to be one of {sorted(KEPT)}, not {mode!r}")


def sanitize(seq: Column, mode: str = "strict", case: str = "upper") -> Column:
    """Every letter that the mode doesn't know becomes N. ``case='preserve'`` keeps lower-case bases."""
    check_mode(mode)
    if case not in ("upper", "preserve"):
        raise ValueError("case has to be 'upper' or 'preserve'")
    seq = F.upper(seq) if case == "upper" else seq
    return F.regexp_replace(seq, "(?i)" + KEPT[mode], "N")


def letters_as_dna(text: Column) -> Column:
    """A deterministic sequence of bases from a text's Latin letters."""
    return F.translate(F.upper(F.regexp_replace(text, "[^a-zA-Z]", "")), LETTERS, BASES_OF_LETTERS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, in ASCII order."""
    return F.least(kmer, reverse_complement(kmer))


def check_mask(mask: str) -> str:
    """Masks begin and end with 1, have length two or more, and read the same both ways."""
    if not re.fullmatch(r"1[01]*1", mask) or mask != mask[::-1]:
        raise ValueError(f"mask has to match 1[01]*1 and be a palindrome, not {mask!r}")
    return mask


def valid_mask(mask: Column) -> Column:
    """What ``check_mask`` asks for, as an expression."""
    return mask.rlike("^1[01]*1$") & (mask == F.reverse(mask))


def maskify(kmer: Column, mask: str) -> Column:
    """Positions under 0 become x, then the canonical form is taken."""
    check_mask(mask)
    parts, at = [], 0
    for m in re.finditer(r"1+|0+", mask):
        parts.append(F.substring(kmer, at + 1, len(m[0])) if m[0][0] == "1" else F.lit("x" * len(m[0])))
        at += len(m[0])
    return canonical(F.concat(*parts))
