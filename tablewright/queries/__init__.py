"""All registered queries and their SQL twins."""

from . import advising, augmenting, filing, modelling, preparing, profiling, typing
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "advising", "augmenting", "filing", "modelling", "preparing", "profiling", "typing"]
