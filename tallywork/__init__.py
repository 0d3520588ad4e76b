"""Customer analytics over raw transaction logs, as Spark DataFrame jobs."""

from .params import Params
from .plans.workspace import Workspace

__all__ = ["Params", "Workspace"]
