"""All named queries and their SQL."""

from . import evidence  # noqa: F401  registers its queries
from .catalogue import QUERIES, SQL, flagship

__all__ = ["QUERIES", "SQL", "flagship"]
