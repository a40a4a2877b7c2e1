"""Different thresholds for different instruments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S


def by_instrument(run: Callable[..., DataFrame], tables: Sequence[DataFrame], settings: Mapping[int, object]) -> DataFrame:
    """``run(*tables, s)`` for the instruments of each setting, results together.

    Instruments with equal settings share one pass; the instrument filter reaches the scans.
    """
    groups: dict[object, list[int]] = {}
    for instrument, s in settings.items():
        groups.setdefault(s, []).append(instrument)
    out = None
    for s, instruments in groups.items():
        one = run(*[t.where(F.col(S.KEY).isin(*instruments)) for t in tables], s)
        out = one if out is None else out.unionByName(one)
    return out
