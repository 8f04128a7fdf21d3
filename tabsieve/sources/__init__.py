"""Where tables come from: the Parquet-backed catalog and the generator of benchmark data."""

from .catalog import Database, Table
from .datagen import benchmark_table

__all__ = ["Database", "Table", "benchmark_table"]
