"""Sketches as states: kept by fine keys, merged over coarser ones without another look at the rows.

Distinct counts are HyperLogLog states, quantiles KLL states. Nulls aren't counted; a key with only nulls has a
count of 0 and a null quantile; repeated rows change no count; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of 2 ** LOG_K registers, a state is off by over COUNT_ERROR in under one of a thousand cases.
LOG_K, COUNT_ERROR = 14, 0.03
#: How far the rank of a quantile is off, in one of a hundred cases.
RANK_ERROR = 0.02


def states(rows: DataFrame, keys: list[str], counted: dict[str, str], spread: dict[str, str] | None = None) -> DataFrame:
    """keys, and a state for each name: of the distinct values of a column (counted) or of how a number is spread."""
    aggs = [F.hll_sketch_agg(F.col(c), F.lit(LOG_K)).alias(n) for n, c in counted.items()]
    aggs += [F.kll_sketch_agg_double(F.col(c).cast("double")).alias(n) for n, c in (spread or {}).items()]
    return rows.groupBy(*keys).agg(*aggs)


def merged(kept: DataFrame, keys: list[str], counted: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """keys, the distinct counts of the states of counted, and the quantile of each of quantiles, over all states of a key."""
    aggs = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in counted]
    aggs += [F.kll_merge_agg_double(n).alias(n) for n in quantiles or {}]
    return kept.groupBy(*keys).agg(*aggs).withColumns({n: F.when(F.kll_sketch_get_n_double(n) > 0, F.kll_sketch_get_quantile_double(n, F.lit(q))) for n, q in (quantiles or {}).items()})
