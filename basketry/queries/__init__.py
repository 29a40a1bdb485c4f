"""Every operator as a named query over the given tables, with SQL for the same result where SQL can express it."""

from basketry.queries import (  # noqa: F401
    aggregates,
    behaviors,
    filtering,
    joining,
    labeling,
    metrics,
    modeling,
    rankings,
    sourcing,
    stacking,
    vectors,
)
from basketry.queries.base import REGISTRY

__all__ = ["REGISTRY"]
