"""All registered queries and their SQL."""

from __future__ import annotations

from corpusloom.plans import edit_queries, label_queries, score_queries, split_queries, stream_queries, taxonomy_queries, text_queries  # noqa: F401 - they register
from corpusloom.plans.registry import QUERIES, SQL  # noqa: F401
