"""User-supplied scorers over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    """What a pluggable model offers; every method maps DataFrames to DataFrames (``tagger.TaggerScorer`` is one)."""

    def train(self, data: DataFrame) -> "Scorer": ...

    def classify(self, data: DataFrame) -> DataFrame: ...

    def evaluate(self, data: DataFrame) -> DataFrame: ...


def score_batches(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch of ``rows``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return rows.mapInPandas(run, schema)
