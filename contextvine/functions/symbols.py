"""Symbols, words and contexts as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = ("A", "C", "G", "T")
P = ("p_a", "p_c", "p_g", "p_t")  # a model's next-symbol probabilities, in the order of SYMBOLS


def normalise(seq: Column) -> Column:
    """Upper case, U read as T, anything else but A, C, G and T read as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """The other strand; N stays N."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def is_word(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def parent(context: Column) -> Column:
    """The context without its oldest symbol."""
    return F.substring(context, 2, 1 << 30)


def background_context(context: Column, order: int) -> Column:
    """The last ``order`` symbols, or all of a shorter context."""
    return F.when(F.length(context) <= order, context).otherwise(F.right(context, F.lit(order)))


def suffixes(word: Column, most: Column | int) -> Column:
    """Array of the suffixes of a word of 0 to ``most`` symbols (no more than it has)."""
    longest = F.least(F.length(word), F.lit(most) if isinstance(most, int) else most)
    # right() of a zero length is the empty context
    return F.transform(F.sequence(F.lit(0), longest), lambda n: F.right(word, n))


def probability(symbol: Column, columns: tuple[str, ...] = P) -> Column:
    """The probability of ``symbol`` in a row that holds a model's four; 0 for any other symbol."""
    out = F.lit(0.0)
    for s, p in zip(reversed(SYMBOLS), reversed(columns)):
        out = F.when(symbol == s, F.col(p)).otherwise(out)
    return out


def log_or_zero(p: Column) -> Column:
    """ln p, and 0 where p is 0: the score of a transition."""
    return F.when(p > 0, F.log(F.when(p > 0, p))).otherwise(F.lit(0.0))


def all_words(k: int) -> list[str]:
    """All words of k symbols in lexicographic order."""
    return ["".join(w) for w in product(SYMBOLS, repeat=k)]


def all_words_column(k: int) -> Column:
    """The same as an array column, grown symbol by symbol in the engine."""
    symbols = F.array(*map(F.lit, SYMBOLS))
    grow = lambda acc, _: F.flatten(F.transform(acc, lambda a: F.transform(symbols, lambda s: F.concat(a, s))))
    if k == 0:
        return F.array(F.lit(""))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array(F.lit("")), grow)
