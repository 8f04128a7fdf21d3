"""The engine: tables by name, queries as text."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import redirect_stdout
from dataclasses import dataclass
from io import StringIO

from pyspark.sql import DataFrame, SparkSession

from .errors import AnalysisError, CatalogError
from .plans.lower import Lowering
from .plans.parser import MODES, parse
from .plans.tree import Select
from .result import Result
from .sources.catalog import Database


@dataclass
class Source:
    df: DataFrame
    key: str | None
    nan_columns: tuple[str, ...] = ()


@dataclass
class Prepared:
    """A query that has been parsed and planned; execute() as often as wanted."""

    tree: Select
    df: DataFrame

    def execute(self) -> Result:
        return Result(self.df)

    def explain(self) -> str:
        with redirect_stdout(StringIO()) as out:
            self.df.explain("formatted")
        return out.getvalue()


class Engine:
    """precedence: see plans.parser. use_multi, use_gpu, use_stream, use_mmap and multi_threads say where a query should run;
    Spark decides that by its master, so they are kept and have no effect on results."""

    def __init__(self, spark: SparkSession | None = None, precedence: str = "standard", use_multi: bool = False, use_gpu: bool = False, use_stream: bool = False, use_mmap: bool = False, multi_threads: int = 8):
        if precedence not in MODES:
            raise ValueError(f"no such mode: {precedence}")
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.precedence = precedence
        self.placement = {"use_multi": use_multi, "use_gpu": use_gpu, "use_stream": use_stream, "use_mmap": use_mmap, "multi_threads": multi_threads}
        self.sources: dict[str, Source] = {}
        self.database: Database | None = None

    def register_df(self, name: str, df: DataFrame, key_column: str | None = None, nan_columns: Iterable[str] = ()) -> Engine:
        """Make df a table; key_column is read as `id`. Float columns that may hold NaN are named in nan_columns."""
        if key_column is not None and key_column not in df.columns:
            raise AnalysisError(f"no such column: {key_column}")
        self.sources[name] = Source(df, key_column, tuple(nan_columns))
        return self

    def register_parquet(self, name: str, path: str, key_column: str | None = None, nan_columns: Iterable[str] = ()) -> Engine:
        return self.register_df(name, self.spark.read.parquet(path), key_column, nan_columns)

    def create_database(self, path: str) -> Database:
        self._no_database()
        self.database = Database.create(self.spark, path)
        return self.database

    def open_database(self, path: str) -> Database:
        self._no_database()
        self.database = Database.open(self.spark, path)
        return self.database

    def _no_database(self) -> None:
        if self.database is not None:
            raise CatalogError("a database is open already")

    def close_database(self) -> None:
        if self.database is not None:
            self.database.close()
            self.database = None

    def close(self) -> None:
        self.close_database()
        for s in self.sources.values():
            s.df.unpersist()
        self.sources = {}

    def source(self, name: str) -> Source:
        if name in self.sources:
            return self.sources[name]
        if self.database is not None and name in self.database.tables:
            t = self.database.tables[name]
            return Source(t.df, t.key, t.nan_columns)
        raise AnalysisError(f"no such table: {name}")

    def prepare(self, text: str, precedence: str | None = None) -> Prepared:
        mode = precedence or self.precedence
        tree = parse(text, mode)
        s = self.source(tree.table)
        return Prepared(tree, Lowering(s.df, s.key, mode, s.nan_columns).select(tree))

    def sql(self, text: str, precedence: str | None = None) -> DataFrame:
        return self.prepare(text, precedence).df

    def query(self, text: str, precedence: str | None = None) -> Result:
        return self.prepare(text, precedence).execute()

    def explain(self, text: str, precedence: str | None = None) -> str:
        return self.prepare(text, precedence).explain()

    def preload(self, name: str) -> None:
        """Keep a table in memory (on disk what does not fit). Rows inserted later are seen: they end the preload."""
        if name in self.sources:
            self.sources[name].df.persist().count()
        else:
            self.source(name)
            self.database.tables[name].preload()

    def release(self, name: str) -> None:
        """Undo preload."""
        if name in self.sources:
            self.sources[name].df.unpersist()
        else:
            self.source(name)
            self.database.tables[name].release()
