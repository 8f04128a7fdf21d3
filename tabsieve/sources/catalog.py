"""A database: a folder with a JSON manifest and one folder of Parquet files per table.

Paths go through Hadoop's file system, so a database can lie in any store that Spark reaches. Rows inserted one by one
are checked, buffered and appended as files of FLUSH_ROWS; bulk data go in as DataFrames. A column added to a table with
rows reads as its default in older files. A manifest is written under a new number and then renamed, so a crash leaves
the one before it. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError
from ..types import ColType, named, of_spark

FLUSH_ROWS = 100_000
_BOUNDS = {ColType.INT: 1 << 31, ColType.INT64: 1 << 63, ColType.CHAR: 1 << 7}


@dataclass(frozen=True)
class Field:
    name: str
    type: ColType
    default: float = 0  # of rows written before the column was added
    may_be_nan: bool = False


def _checked(value, kind: ColType, what: str):
    """value as the type wants it; CatalogError if it is none of that type. Null is allowed."""
    if value is None:
        return None
    if kind.is_float and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if not kind.is_float and isinstance(value, int) and not isinstance(value, bool) and -_BOUNDS[kind] <= value < _BOUNDS[kind]:
        return value
    raise CatalogError(f"{what} cannot hold {value!r}")


class Table:
    def __init__(self, db: Database, name: str, key: str, key_type: ColType, columns: list[Field] | None = None):
        self.db, self.name, self.key, self.key_type = db, name, key, key_type
        self.columns = columns or []
        self._rows: list[tuple] = []
        self._kept: DataFrame | None = None

    @property
    def path(self) -> str:
        return f"{self.db.path}/tables/{self.name}"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(self.key, self.key_type.spark), *[T.StructField(c.name, c.type.spark) for c in self.columns]])

    @property
    def nan_columns(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.may_be_nan)

    def add_column(self, name: str, kind: str | ColType, default: float = 0, may_be_nan: bool = False) -> None:
        """may_be_nan: a float column that may hold NaN or infinities."""
        self.db._must_be_open()
        if name == self.key or name in [c.name for c in self.columns]:
            raise CatalogError(f"{self.name} has a column {name} already")
        kind = named(kind)
        default = _checked(default, kind, name)
        self.flush()
        self.release()
        self.columns.append(Field(name, kind, default, may_be_nan))
        self.db._save()

    def column_id(self, name: str) -> int:
        """The column's place, from 0; the key has none."""
        for i, c in enumerate(self.columns):
            if c.name == name:
                return i
        raise CatalogError(f"{self.name} has no column {name}")

    def column_type(self, name: str) -> ColType:
        return self.columns[self.column_id(name)].type

    def insert(self, key, *values) -> None:
        """Append a row: the key and a value for each column. NaN and infinities only where a column may hold them."""
        self.db._must_be_open()
        if len(values) != len(self.columns):
            raise CatalogError(f"{self.name} has {len(self.columns)} columns, not {len(values)}")
        row = [_checked(key, self.key_type, self.key)]
        for c, v in zip(self.columns, values):
            row.append(v := _checked(v, c.type, c.name))
            if isinstance(v, float) and not math.isfinite(v) and not c.may_be_nan:
                raise CatalogError(f"{c.name} cannot hold {v!r}")
        self._rows.append(tuple(row))
        if len(self._rows) >= FLUSH_ROWS:
            self.flush()

    def insert_many(self, rows: Iterable[Sequence]) -> None:
        for row in rows:
            self.insert(*row)

    def insert_df(self, df: DataFrame) -> None:
        """Append a DataFrame that has the key and all columns, under their names and types."""
        self.db._must_be_open()
        want = self.schema
        if sorted((f.name, of_spark(f.dataType)) for f in df.schema) != sorted((f.name, of_spark(f.dataType)) for f in want):
            raise CatalogError(f"the rows do not have the columns of {self.name}")
        self.flush()
        self.release()
        df.select(*[F.col(f"`{f.name}`") for f in want]).write.mode("append").parquet(self.path)

    def flush(self) -> None:
        if self._rows:
            self.release()
            self.db.spark.createDataFrame(self._rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
            self._rows = []

    @property
    def df(self) -> DataFrame:
        self.flush()
        if self._kept is not None:
            return self._kept
        spark = self.db.spark
        if not self.db._exists(self.path):
            return spark.createDataFrame([], self.schema)
        df = spark.read.schema(self.schema).parquet(self.path)
        fill = {c.name: F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default).cast(c.type.spark)).alias(c.name) for c in self.columns if self._late(c.name)}
        return df.select(*[fill.get(f.name, F.col(f"`{f.name}`")) for f in self.schema]) if fill else df

    def _late(self, name: str) -> bool:
        return name in self.db._late.get(self.name, ())

    def num_rows(self) -> int:
        return self.df.count()

    def preload(self) -> DataFrame:
        """Keep the table in memory (on disk what does not fit), until it grows or is released."""
        df = self.df.persist()
        df.count()
        self._kept = df
        return df

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def to_csv(self, path: str) -> None:
        """A folder of CSV files with a header each: the key and all columns."""
        self.df.write.csv(path, header=True, mode="errorifexists")


class Database:
    """Use create() or open()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: dict[str, Table] = {}
        self._late: dict[str, list[str]] = {}
        self.is_open = True

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _manifests(self) -> list[str]:
        """The paths of the manifests, the newest last."""
        fs, p = self._fs(f"{self.path}/manifest-*.json")
        return sorted(str(f.getPath().toString()) for f in fs.globStatus(p) or [])

    def _must_be_open(self) -> None:
        if not self.is_open:
            raise CatalogError("the database is closed")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> Database:
        db = cls(spark, path)
        if db._manifests():
            raise CatalogError(f"{path} exists")
        db._save()
        return db

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        db = cls(spark, path)
        if not (found := db._manifests()):
            raise CatalogError(f"{path} is no database")
        try:
            spec = json.loads("\n".join(r.value for r in spark.read.text(found[-1], wholetext=True).collect()))
            for t in spec["tables"]:
                db.tables[t["name"]] = Table(db, t["name"], t["key"], named(t["key_type"]), [Field(n, named(k), d, nan) for n, k, d, nan in t["columns"]])
                db._late[t["name"]] = t["late"]
        except (ValueError, KeyError, TypeError) as e:
            raise CatalogError(f"{path} has a broken manifest") from e
        return db

    def _save(self) -> None:
        for t in self.tables.values():
            if self._exists(t.path):
                seen = self._late.setdefault(t.name, [])
                have = set(self.spark.read.parquet(t.path).columns)
                seen += [c.name for c in t.columns if c.name not in have and c.name not in seen]
        spec = [{"name": t.name, "key": t.key, "key_type": t.key_type.name, "columns": [[c.name, c.type.name, c.default, c.may_be_nan] for c in t.columns], "late": self._late.get(t.name, [])} for t in self.tables.values()]
        old = self._manifests()
        number = int(old[-1].rsplit("-", 1)[1].removesuffix(".json")) + 1 if old else 0
        fs, p = self._fs(f"{self.path}/manifest-{number:08d}.json")
        draft = p.suffix(".tmp")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"tables": spec}), "utf-8"))
        out.close()
        if not fs.rename(draft, p):
            raise CatalogError(f"{self.path} cannot be written")
        for o in old:
            fs.delete(self._fs(o)[1], False)

    def create_table(self, name: str, key_type: str | ColType = "int", key: str = "id") -> Table:
        self._must_be_open()
        if name in self.tables:
            raise CatalogError(f"there is a table {name} already")
        self.tables[name] = Table(self, name, key, named(key_type))
        self._save()
        return self.tables[name]

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogError(f"no such table: {name}")
        return self.tables[name]

    def table_id(self, name: str) -> int:
        """The table's place, from 0."""
        self.table(name)
        return list(self.tables).index(name)

    def close(self) -> None:
        """Write what is buffered. Closing twice does nothing."""
        if self.is_open:
            for t in self.tables.values():
                t.flush()
                t.release()
            self._save()
            self.is_open = False
