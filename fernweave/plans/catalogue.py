"""All registered queries of the analytics operators, with their DuckDB SQL."""

from fernweave.plans import benchmark, choice, editing, frames, gates, judging, manifests, media, palettes, projects, reporting, timeline  # noqa: F401  they register their queries
from fernweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
