"""Column functions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(seq: Column | str) -> Column:
    """A and T, C and G swapped; any other letter becomes N. Lower case counts as upper case."""
    up = F.upper(seq)
    return F.translate(F.regexp_replace(up, "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def canonical(kmer: Column | str) -> Column:
    """The smaller of an upper-case ACGT string and its reverse complement, by byte order."""
    kmer = F.col(kmer) if isinstance(kmer, str) else kmer
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def letters_of(word: Column | str, k: int) -> Column:
    """The k letters of a k-mer that is packed into a long, two bits a base."""
    word = F.col(word) if isinstance(word, str) else word
    digit = lambda i: F.call_function("shiftright", word, F.lit(2 * (k - 1)) - 2 * i).bitwiseAND(3)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(F.lit("ACGT"), (digit(i) + 1).cast("int"), F.lit(1))), "")


def base_id(path: Column | str) -> Column:
    """What follows the last slash, without its last extension; a name that is all extension raises an error."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.when((name == "") & F.substring_index(path, "/", -1).startswith("."), F.raise_error(F.concat(F.lit("no base name in "), path)).cast("string")).otherwise(name)


def contig_label(header: Column | str) -> Column:
    """A header line's label: spaces become underscores, tabs stay."""
    return F.replace(header if isinstance(header, Column) else F.col(header), F.lit(" "), F.lit("_"))


#: White space and punctuation that vanish; a to z and A to Z onto A, C, G, T in turn.
_DROP = r"[ \n\t.,]+"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26]


def text_to_bases(text: Column | str) -> Column:
    """A deterministic stand-in for DNA: letters onto the four bases, other characters onto N."""
    bare = F.regexp_replace(text, _DROP, "")
    return F.regexp_replace(F.translate(bare, _LETTERS + _LETTERS.upper(), _BASES * 2), "[^ACGT]", "N")


def similarity_of(matched: Column, total: Column) -> Column:
    """matched / total; NaN for an empty probe."""
    return F.when(total == 0, F.lit(float("nan"))).otherwise(matched / F.when(total != 0, total))
