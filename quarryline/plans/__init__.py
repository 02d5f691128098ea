"""Query plans over the test tables, each with its DuckDB counterpart."""

from . import models, queries  # noqa: F401
