"""The first rows, in some order, of those that another table knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from keysieve.operators.skew import skew_join
from keysieve.workspace import stored

GROW, ROUNDS, MOST = 16, 3, 10_000


def first_known(rows: DataFrame, known: DataFrame, on: list[str], order: list[Column], n: int
                ) -> DataFrame:
    """The first ``n`` rows of ``rows`` joined to ``known``, without joining the others.

    Each task finds its own first rows, and only the first of all meet the join.  If enough of
    them survive it, no other row can come before these.  If not, more are taken, and in the
    end all.  ``order`` has to be a total one, and ``known`` one row per key.
    """
    most = 4 * n
    for _ in range(ROUNDS):
        if most > MOST:
            break
        best = stored(rows.orderBy(*order).limit(most), "best")
        kept = stored(best.join(known, on), "known")
        if kept.count() >= n or best.count() < most:
            return kept.orderBy(*order).limit(n)
        most *= GROW
    return skew_join(rows, known, on).orderBy(*order).limit(n)
