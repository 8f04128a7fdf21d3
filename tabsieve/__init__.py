"""A PySpark-native engine for single-table SELECT / WHERE queries over numeric columns."""

from .errors import AnalysisError, CatalogError, EngineError, ParseError
from .result import Result
from .session import Engine, Prepared
from .sources.catalog import Database, Table
from .timing import Timer
from .types import ColType

__all__ = ["AnalysisError", "CatalogError", "ColType", "Database", "Engine", "EngineError", "ParseError", "Prepared", "Result", "Table", "Timer"]
