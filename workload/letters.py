"""A small vectoriser that SQL can repeat: relative letter counts."""

from __future__ import annotations

import string

import numpy as np

from shortlist.operators.embed import BatchVectoriser

_LETTERS = string.ascii_lowercase


def _loader():
    letters = _LETTERS

    def load():     # local, so workers need not have this package installed
        def vectors(texts: list[str]) -> np.ndarray:
            return np.array([[t.count(c) for c in letters] for t in map(str.lower, texts)], dtype=np.float64)
        return vectors
    return load


LETTERS = BatchVectoriser("letters", _loader())


def letters_sql(text: str) -> str:
    """Unit-length letter counts of a text column, with the same rounding to single precision."""
    low = f"lower(coalesce({text}, ''))"
    counts = f"[CAST(length({low}) - length(replace({low}, c, '')) AS DOUBLE) for c in string_split('{_LETTERS}', '')]"
    return (f"(SELECT CASE WHEN n = 0 THEN v ELSE [CAST(CAST(x / n AS FLOAT) AS DOUBLE) for x in v] END FROM "
            f"(SELECT v, sqrt(list_sum([x * x for x in v])) AS n FROM (SELECT {counts} AS v)))")
