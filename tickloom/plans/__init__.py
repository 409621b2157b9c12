"""Plan builders for what Spark has no operator for: interval joins, as-of lookups and total orders."""

from .intervals import as_of, overlap_join, point_join
from .slabs import global_lag, global_rank, global_sum

__all__ = ["as_of", "global_lag", "global_rank", "global_sum", "overlap_join", "point_join"]
