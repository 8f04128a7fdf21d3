"""A query's result and a cursor over it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import AnalysisError


class Result:
    """Wraps a lazy DataFrame. Rows come in no order that could be relied on. The cursor reads partition by partition; the
    driver holds one partition at most. A partition with rows is a block."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._total: int | None = None
        self.rewind()

    def rewind(self) -> None:
        """Put the cursor before the first row."""
        self._cursor: Iterator[tuple[int, Row]] | None = None
        self._held: tuple[int, Row] | None = None  # read, but not given out
        self._block: int | None = None
        self._taken = 0

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def rows(self) -> Iterator[Row]:
        """All rows, from the first."""
        return self.df.toLocalIterator()

    def next_row(self) -> Row | None:
        """The cursor's next row; None after the last."""
        if (got := self._read()) is None:
            return None
        self._held, self._block = None, got[0]
        self._taken += 1
        return got[1]

    def next_block(self) -> bool:
        """Move the cursor over the rest of its block, to the first row of the next one. False if there is none: the
        cursor is then after the last row."""
        while (got := self._read()) is not None and got[0] == self._block:
            self._held = None
            self._taken += 1
        self._block = None if got is None else got[0]
        return got is not None

    def _read(self) -> tuple[int, Row] | None:
        if self._held is None:
            self._cursor = self._cursor or self._numbered()
            self._held = next(self._cursor, None)
        return self._held

    def _numbered(self) -> Iterator[tuple[int, Row]]:
        """(partition, row), from the first."""
        make, name = Row(*self.columns), "_part"
        while name.lower() in {c.lower() for c in self.columns}:
            name += "_"
        for *row, part in self.df.select("*", F.spark_partition_id().alias(name)).toLocalIterator():
            yield part, make(*row)

    def count(self) -> int:
        """Counted once; a result does not change."""
        if self._total is None:
            self._total = self.df.count()
        return self._total

    def remaining(self) -> int:
        """Rows that the cursor has not read; does not move it."""
        return self.count() - self._taken

    def blocks(self) -> Iterator[list[Row]]:
        """The rows, a partition at a time."""
        for _, rows in groupby(self._numbered(), key=lambda got: got[0]):
            yield [row for _, row in rows]

    def format_row(self, row: Row) -> str:
        """Values right-aligned to 10, floats with two decimals, NULL for null; other types than numbers raise."""
        out = []
        for v, f in zip(row, self.schema.fields):
            if v is None and isinstance(f.dataType, T.NumericType):
                out.append(f"{'NULL':>10}")
            elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                out.append(f"{v:10.2f}")
            elif isinstance(f.dataType, T.IntegralType):
                out.append(f"{v:10d}")
            else:
                raise AnalysisError(f"{f.name} cannot be printed")
        return "".join(out)

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def to_csv(self, path: str) -> None:
        """A folder of CSV files with a header each."""
        self.df.write.csv(path, header=True, mode="errorifexists")

    def preload(self) -> Result:
        self.df.persist()
        self.df.count()
        return self

    def release(self) -> None:
        self.df.unpersist()
        self.rewind()
