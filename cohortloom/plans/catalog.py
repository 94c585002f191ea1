"""All registered queries."""

from . import cleaning, grading, learning, linking, relational, similarity, sources, statistics  # noqa: F401
from .registry import QUERIES, oracles  # noqa: F401
