"""Every operator as a runnable query over the given tables."""

from seqloom.registry import ENTRIES
from seqloom.queries import (  # noqa: F401
    aggregates, embedding, joins, probes, projections, sequences, sets, sources, splitters, windows,
)

__all__ = ["ENTRIES"]
