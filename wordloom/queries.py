"""All registered queries but those of the optional training-data operators."""

from __future__ import annotations

from .functions import deconjugation, text_queries, tokenizer, tokens  # noqa: F401
from .operators import browsing, difficulty, export, frequency, hierarchy, loading, search, serving, text_stats  # noqa: F401
from .plans.registry import ORACLES, QUERIES
from .sources import script_queries, user_dictionary  # noqa: F401
from .streaming import limits, rates  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
