"""Where the cells of a query come from: a stored rollup, if there is one, or the events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidegrid.functions.timeaxis import Range
from tidegrid.operators import rollup
from tidegrid.params import Params
from tidegrid.sources.store import MetricStore


def cells_of(events: DataFrame, params: Params, pattern: Sequence[str], span: Range, stores: Sequence[MetricStore] = ()) -> DataFrame:
    """The cells that match a pattern, from the first store with the same duration and resolution, else from the events.

    The stores must hold what the events hold: a stored rollup has been summed up already and is pruned by epoch, depth and
    first field; events are summed up for the pattern's level and the range's epochs only.
    """
    for store in stores:
        if (store.params.duration, store.params.resolution) == (params.duration, params.resolution):
            return rollup.cells_at(store.cells(), pattern)
    return rollup.rollup_at(events, params, pattern, span)
