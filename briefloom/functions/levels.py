"""Detail levels and list limits as Column expressions (no lookup join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# Brief context limits per level: (outputs, sessions, doc summaries).
CONTEXT_LIMITS = {"compact": (2, 2, 3), "standard": (5, 5, 8), "detailed": (10, 8, 15)}
# Handoff limits: default, full, compact (full wins over compact).
EXPORT_LIMITS = {"default": (5, 5, 10), "full": (10, 10, 20), "compact": (2, 2, 5)}
# Accepted level spellings.
LEVEL_ALIASES = {"compact": "compact", "standard": "standard", "": "standard",
                 "detailed": "detailed", "full": "detailed"}
# Listing cap for outputs and sessions.
LISTING_CAP = 100
# ---------------------------------------------------------------------------

MAX_CONTEXT_DOCS = max(v[2] for v in CONTEXT_LIMITS.values())
MAX_CONTEXT_OUTPUTS = max(v[0] for v in CONTEXT_LIMITS.values())
MAX_CONTEXT_SESSIONS = max(v[1] for v in CONTEXT_LIMITS.values())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def requested_level(level, compact_only, full) -> Column:
    """An explicit level wins; else compact-only -> compact; else full -> detailed."""
    level = F.coalesce(_c(level), F.lit(""))
    return (F.when(level != "", level)
            .when(_c(compact_only), "compact")
            .when(_c(full), "detailed")
            .otherwise(""))


def normalize_level(level) -> Column:
    """Parsed level; unknown spellings fall back to standard (see ``level_is_valid``)."""
    level = _c(level)
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in LEVEL_ALIASES.items():
        expr = expr.when(level == k, v)
    return expr.otherwise("standard")


def level_is_valid(level) -> Column:
    return F.coalesce(_c(level), F.lit("")).isin(list(LEVEL_ALIASES))


def _limit(level: Column, idx: int) -> Column:
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in CONTEXT_LIMITS.items():
        expr = expr.when(level == k, F.lit(v[idx]))
    return expr.otherwise(F.lit(CONTEXT_LIMITS["standard"][idx]))


def max_outputs(level) -> Column:
    return _limit(_c(level), 0)


def max_sessions(level) -> Column:
    return _limit(_c(level), 1)


def max_docs(level) -> Column:
    return _limit(_c(level), 2)


def export_limits(full: bool, compact: bool) -> tuple[int, int, int]:
    if full:
        return EXPORT_LIMITS["full"]
    if compact:
        return EXPORT_LIMITS["compact"]
    return EXPORT_LIMITS["default"]
