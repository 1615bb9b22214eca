"""Column references, predicates, aggregates and window functions."""

from .items import avg, count, count_gt, count_gte, count_lt, dense_rank, lag, lead, max_, min_, rank, row_number, sum_
from .refs import ColumnRef, exists, not_exists, raw

__all__ = ["ColumnRef", "avg", "count", "count_gt", "count_gte", "count_lt", "dense_rank", "exists", "lag", "lead", "max_", "min_", "not_exists", "rank", "raw", "row_number", "sum_"]
