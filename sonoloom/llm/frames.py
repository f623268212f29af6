"""Frames for Arrow transfer."""

from __future__ import annotations

import pandas as pd


def frame(rows: list, columns: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects, which the declared schema turns into Arrow columns, also when there are none."""
    return pd.DataFrame(rows, columns=columns, dtype=object)
