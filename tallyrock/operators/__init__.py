"""Relational operators over DataFrames; Catalyst plans them."""

from .aggregate import aggregate
from .join import inner_join, join_chain, left_join, qualify, right_join, without_match
from .select import Item, asc, constants, desc, distinct, distinct_ordered, keep, limit, order, project, star, top_k

__all__ = [n for n in dir() if not n.startswith("_")]
