"""Imports every module that registers queries."""

from lectern.plans import books, evaluation, genres, intelligence, joins, rag, resolution, retrieval, scanned, text, vision  # noqa: F401
from lectern.sources import records  # noqa: F401
from lectern.streaming import jobs, stateful  # noqa: F401
