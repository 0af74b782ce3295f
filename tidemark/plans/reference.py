"""All registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from tidemark.plans import ref_grids, ref_series, ref_spectra, ref_stats

_PARTS = (ref_grids, ref_series, ref_stats, ref_spectra)


def queries():
    return {name: q for part in _PARTS for name, q in part.queries().items()}


ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
