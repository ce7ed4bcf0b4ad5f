"""Rows of a pandas batch by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def by_key(batch: pd.DataFrame, key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Each value of the key, nulls left out, with its rows. Not by pandas' groupby, for which strings end at a null character, and keys of several parts have one between these."""
    places: dict[object, list[int]] = {}
    for i, (value, known) in enumerate(zip(batch[key], batch[key].notna(), strict=True)):
        if known:
            places.setdefault(value, []).append(i)
    for value, at in places.items():
        yield value, batch.iloc[at]
