"""Token-sequence Column expressions: tokens, shingles, set similarity, positional alignment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(_c(text), r"\s+"), lambda x: x != "")


def lines(text) -> Column:
    """Blocks of an entity: its lines."""
    return F.split(_c(text), "\n")


def _pairs_of(toks: Column) -> Column:
    """Consecutive pairs as zip(t[1..n-1], t[2..n]): each array is evaluated once (linear)."""
    n = F.size(toks)
    return F.when(n >= 2, F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                                     lambda x, y: F.concat(x, F.lit(" "), y))
                  ).otherwise(F.array().cast("array<string>"))


def shingles(text, cross_blocks: bool = True) -> Column:
    """Overlapping pairs of consecutive tokens; without crossing, pairs never span a line break."""
    if cross_blocks:
        # As a lambda's variable the tokens are split once, not once for each time that they are named.
        return F.get(F.transform(F.array(tokens(text)), _pairs_of), 0)
    return F.flatten(F.transform(lines(text), lambda ln: _pairs_of(tokens(ln))))


def equal_positions(a, b) -> Column:
    """Number of positions holding equal values."""
    return F.size(F.filter(F.zip_with(_c(a), _c(b), lambda x, y: x == y), lambda z: z))


def minhash_similarity(a, b) -> Column:
    """Share of equal signature positions."""
    return equal_positions(a, b) / F.size(_c(a))


def positional_alignment(a, b) -> Column:
    """Sequences of equal length matched position by position.

    A mismatch counts as two gap entries, so score = m / (2n - m); unequal
    lengths are not aligned (NULL); two empty sequences have no entries (NULL).
    """
    n = F.size(_c(a))
    return F.when(n == F.size(_c(b)), positional_score(equal_positions(a, b), n))


def positional_score(matches, n) -> Column:
    """The score of two sequences of length ``n`` from their number of equal positions."""
    m, n = _c(matches), _c(n)
    return F.try_divide(m.cast("double"), (2 * n - m).cast("double"))
