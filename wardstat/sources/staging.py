"""File tables parsed once, with the malformed rows counted in the same pass.

``stage_tables``       — file tables written as Parquet into a workspace while an
                         ``Observation`` counts their rows.
``observe_malformed``  — file tables that count their malformed rows in whatever pass
                         reads them next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wardstat.dataset import OmopDataset
from wardstat.sources.tables import MALFORMED, check_counts
from wardstat.workspace import Workspace


def _observed(flags: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The good rows of a table with marked rows, and what counts them."""
    seen = Observation(f"rows of {name}")
    rows = flags.observe(seen, F.count(F.lit(1)).alias("n"),
                         F.count(F.when(F.col(MALFORMED), 1)).alias("bad"))
    return rows.where(~F.col(MALFORMED)).drop(MALFORMED), seen


def stage_tables(ds: OmopDataset, columns: Mapping[str, Sequence[str]], work: Workspace,
                 whole: bool = False) -> tuple[OmopDataset, dict[str, int]]:
    """``ds`` with the file tables that ``columns`` names as Parquet tables in ``work``,
    and the number of malformed rows of each.  A table is read once here; all later
    passes read the columns they want of the typed copy.  Only ``columns`` are kept
    unless ``whole``.  A table that loses all its rows is an error.  Tables whose rows
    cannot be malformed stay as they are."""
    staged, counts = {}, {}
    for name, wanted in columns.items():
        if name not in ds or name not in ds.flagged:
            continue
        rows, seen = _observed(ds.flagged[name], name)
        staged[name] = work.written(rows if whole else rows.select(*wanted), name)
        counts[name] = check_counts(name, seen.get["n"], seen.get["bad"])
    return ds.replace(**staged), counts


def observe_malformed(ds: OmopDataset, names: Iterable[str]
                      ) -> tuple[OmopDataset, Callable[[], dict[str, int]]]:
    """``ds`` with its file tables ``names`` counted by the next pass over each, and a
    function that gives the numbers of malformed rows once those passes have run."""
    seen: dict[str, Observation] = {}
    changed = {}
    for name in names:
        if name in ds.flagged:
            changed[name], seen[name] = _observed(ds.flagged[name], name)

    def counts() -> dict[str, int]:
        return {name: check_counts(name, s.get["n"], s.get["bad"]) for name, s in seen.items()}

    return ds.replace(**changed), counts
