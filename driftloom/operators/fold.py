"""Ordered fold: a sequential state machine per key, streamed in order with bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Run one step function per key over its rows in order.

    `start()` makes a fresh step function for a key; it is called with consecutive batches of
    the key's rows and keeps its state in between. A step with a `finish` attribute is asked
    for last rows at the end of the key. Rows arrive by a shuffle on the keys and a spillable
    sort, batch by batch, so a long key is never held in memory as a whole. Use it for
    pre-aggregated rows (one per detector check, or per packed run of errors).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = start()
        for batch in batches:
            yield step(batch)
        if hasattr(step, "finish"):
            yield step.finish()

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.groupBy(*keys).applyInPandas(run, schema)
