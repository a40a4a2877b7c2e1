"""Many bounded groups per task.

``applyInPandas`` pays a fixed price per group, which dominates when a tape is
cut into many small slices.  Here rows arrive as sorted Arrow batches, groups
are cut out of them one after the other, and results leave in batches.  A task
holds one group at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUTPUT_ROWS = 20_000


def edges(pdf: pd.DataFrame, by: Sequence[str]) -> list[tuple[int, int]]:
    """Stretches of equal ``by`` in a frame sorted by it."""
    changed = np.zeros(len(pdf), dtype=bool)
    for c in by:
        values = pdf[c].to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    at = [0, *np.flatnonzero(changed).tolist(), len(pdf)]
    return list(zip(at[:-1], at[1:]))


def grouped_map(
    df: DataFrame, by: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``fn`` applied to each ``by`` group, its rows sorted by ``by`` and ``order``."""
    by = list(by)

    def run(batches):
        held: list[pd.DataFrame] = []
        key, ready, size = None, [], 0

        def finished() -> pd.DataFrame:
            whole = held[0] if len(held) == 1 else pd.concat(held)
            return fn(whole.reset_index(drop=True))

        for pdf in batches:
            if pdf.empty:
                continue
            for lo, hi in edges(pdf, by):
                piece = pdf.iloc[lo:hi]
                this = tuple(pdf[c].iat[lo] for c in by)
                if held and this != key:
                    ready.append(finished())
                    size += len(ready[-1])
                    held.clear()
                    if size >= OUTPUT_ROWS:
                        yield pd.concat(ready, ignore_index=True)
                        ready, size = [], 0
                key = this
                held.append(piece)
        if held:
            ready.append(finished())
        if ready:
            yield pd.concat(ready, ignore_index=True)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
