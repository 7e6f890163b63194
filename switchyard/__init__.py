"""Query-routing analytics as Spark DataFrame jobs.

Decide, at table scale, which candidate model should answer each query, and
measure how good that decision is.  Every operator takes and returns
DataFrames; nothing keeps global state.
"""

from switchyard.config import RouterConfig
from switchyard.models import Models

__all__ = ["Models", "RouterConfig"]
