"""Named analysis plans and the query registry."""

from . import comparisons, registry  # noqa: F401  each registers its queries
