"""Which physical way a vector search takes: what the caller says, at every size."""

from __future__ import annotations

MODES = ("graph", "codes", "exact")


def mode_of(name: str) -> str:
    """graph: walk the stored graphs, filters restrict results; codes: scan the stored int8 codes behind the sign bits and re-score; exact: scan the
    vectors, filters come before scoring."""
    if name not in MODES:
        raise ValueError(f"unknown mode {name!r}; expected one of {MODES}")
    return name


def beam(k: int, ef: int | None) -> int:
    """Candidates of an approximate search: as asked, else eight times k, at least k."""
    return max(ef or 8 * k, k)
