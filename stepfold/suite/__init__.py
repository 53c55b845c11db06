"""All registered queries."""

from stepfold.suite import (  # noqa: F401
    learning, memory_jobs, quality_jobs, record_jobs, reports, sampling, source_jobs, stream_jobs, text_jobs,
)
from stepfold.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
