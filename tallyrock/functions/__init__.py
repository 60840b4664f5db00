"""Scalar functions, predicates and aggregates with the dialect's meaning, as Spark columns."""

from .aggregates import avg_of, count_all, count_distinct_of, count_of, first_of, max_of, min_of, sum_of
from .predicates import between, definitely, in_list, is_false, like, not_between, not_in_list, not_like, truth
from .scalar import abs_of, clock, coalesce_of, concat_of, divide, length_of, lower_of, modulo, negate, upper_of

__all__ = [n for n in dir() if not n.startswith("_")]
