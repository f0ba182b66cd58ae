"""The query catalogue; importing it registers every query."""

from reviewflow.plans import (dashboard, ingest, lifecycle, prompts, quality, retrieval,  # noqa: F401
                              review, sources, streams, text)
from reviewflow.plans.registry import oracle_sql, queries  # noqa: F401
