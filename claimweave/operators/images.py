"""Legibility of page images: histogram threshold, ink contrast and edge energy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CONTRAST, MIN_EDGES = 80, 200


def otsu_threshold(grey: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between both sides."""
    hist = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(spread, nan=-1.0).argmax())


def ink_contrast(grey: np.ndarray) -> float:
    """Mean of the paper minus mean of the ink."""
    ink = grey <= otsu_threshold(grey)
    return 0.0 if ink.all() or not ink.any() else float(grey[~ink].mean() - grey[ink].mean())


def edge_energy(grey: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian."""
    g = grey.astype(float)
    inside = g[1:-1, 1:-1]
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * inside).var()) if inside.size else 0.0


def measure(pages: DataFrame) -> DataFrame:
    """Adds ink_contrast, edge_energy and legible to (page_id, width, pixels): 8-bit grey rows in a binary."""

    @F.pandas_udf("ink_contrast double, edge_energy double")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for widths, pixels in batches:
            grey = [np.frombuffer(p, np.uint8).reshape(-1, w) for w, p in zip(widths, pixels, strict=True)]
            yield pd.DataFrame({"ink_contrast": [ink_contrast(g) for g in grey], "edge_energy": [edge_energy(g) for g in grey]})

    measured = pages.withColumn("_m", both("width", "pixels")).select(*pages.columns, "_m.*")
    return measured.withColumn("legible", legible(F.col("ink_contrast"), F.col("edge_energy")))


def legible(contrast: Column, edges: Column) -> Column:
    return (contrast >= MIN_CONTRAST) & (edges >= MIN_EDGES)
