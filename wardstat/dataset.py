"""An immutable set of named OMOP tables (name -> DataFrame)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame


class OmopDataset(Mapping):
    """Read-only mapping of table name to DataFrame.

    Operators never mutate a dataset; they return a new one with
    ``replace``.  Absent tables are simply missing keys.
    """

    def __init__(self, tables: Mapping[str, DataFrame],
                 flagged: Mapping[str, DataFrame] | None = None):
        self._tables = dict(tables)
        # file tables with malformed rows still in, marked (see sources.tables)
        self.flagged = dict(flagged or {})

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self._tables[name]
        except KeyError:
            raise KeyError(f"table {name!r} is not in this dataset "
                           f"(have: {sorted(self._tables)})") from None

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def replace(self, **tables: DataFrame) -> "OmopDataset":
        return OmopDataset({**self._tables, **tables}, self.flagged)

    def __repr__(self) -> str:
        return f"OmopDataset({sorted(self._tables)})"
