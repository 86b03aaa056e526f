"""Every registered query with the SQL that checks it."""

from workload import (  # noqa: F401
    curation, evaluation, grounding, sources, streaming, temporal, text)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
