"""Reverse complement of sequences and node ids, overlap concatenation, prefixes: built-in functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rc_sequence(c: Column | str) -> Column:
    """A and T, C and G change places, anything else stays; then the order is reversed."""
    return F.reverse(F.translate(col(c), "ACGT", "TGCA"))


def rc_node(c: Column | str) -> Column:
    """The node of the other strand: a leading minus comes or goes."""
    c = col(c)
    return F.when(F.startswith(c, F.lit("-")), F.substr(c, F.lit(2))).otherwise(F.concat(F.lit("-"), c))


def canonical(c: Column | str) -> Column:
    """One name for a node and its reverse complement."""
    c = col(c)
    return F.least(c, rc_node(c))


def kmer_node(c: Column | str) -> Column:
    """The node of a k-mer: the lesser of it and its reverse complement, with a minus for the other strand."""
    c = col(c)
    return F.when(c <= rc_sequence(c), c).otherwise(F.concat(F.lit("-"), rc_sequence(c)))


def kmer_number(c: Column | str) -> Column:
    """A sequence of at most 31 bases A, C, G, T as a number of two bits each."""
    return F.conv(F.translate(col(c), "ACGT", "0123"), 4, 10).cast("bigint")


def kmer_text(c: Column | str, k: int) -> Column:
    """The k bases of such a number: looked up by fours."""
    c, parts = col(c), []
    for at in range(0, k, 4):
        n = min(4, k - at)
        words = F.split(F.lit(",".join(map("".join, itertools.product("ACGT", repeat=n)))), ",")
        parts.append(F.get(words, F.shiftright(c, 2 * (k - at - n)).bitwiseAND(F.lit(4**n - 1)).cast("int")))
    return F.concat(*parts)


def kmer_mirrored(c: Column | str, k: int) -> Column:
    """The number of the reverse complement of such a number: all bits turned, pairs of bits in the other order."""
    x = F.bitwise_not(col(c))
    for n, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftright(x, n).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), n))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def node_number(c: Column | str, k: int) -> Column:
    """A k-mer's node as a number that sorts as its name does: the other strand's nodes first."""
    c = col(c)
    return F.when(F.startswith(c, F.lit("-")), kmer_number(F.substr(c, F.lit(2)))).otherwise(kmer_number(c) + F.lit(1 << 2 * k))


def node_of(c: Column | str, k: int) -> Column:
    """The same number, of a k-mer's number."""
    c = col(c)
    back = kmer_mirrored(c, k)
    return F.when(c <= back, c + F.lit(1 << 2 * k)).otherwise(back)


def node_text(c: Column | str, k: int) -> Column:
    """The name of such a number's node."""
    c = col(c)
    return F.when(c >= 1 << 2 * k, kmer_text(c % (1 << 2 * k), k)).otherwise(F.concat(F.lit("-"), kmer_text(c, k)))


def palindromic(src: Column | str, dst: Column | str) -> Column:
    """Whether a step runs from a node to its own reverse complement."""
    return col(src) == rc_node(dst)


def joined(sequences: Column, k: int) -> Column:
    """One sequence of an array of sequences that overlap by k: the first whole, of the others what comes after k."""
    rest = F.transform(F.slice(sequences, 2, F.greatest(F.size(sequences) - 1, F.lit(0))), lambda s: F.substr(s, F.lit(k + 1)))
    return F.concat(F.get(sequences, F.lit(0)), F.array_join(rest, ""))


def window(c: Column | str, k: int, size: int) -> Column:
    """At most ``size`` bases after the first k."""
    return F.substr(col(c), F.lit(k + 1), F.lit(size))
