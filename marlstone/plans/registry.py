"""All queries of the engine's own operators."""

from . import checks, diffs, documents, pages, pagework, search, state, streams  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
