"""Importing the query modules registers their queries."""

from . import bar_queries, signal_queries, window_queries  # noqa: F401, I001
from . import board_queries, evaluation_queries, fill_queries, model_queries, more_queries, scan_queries, stream_queries  # noqa: F401
from . import family_queries  # noqa: F401, I001
from .registry import QUERIES, SQL  # noqa: F401
