"""Importing this package registers all queries."""

from lintlake.plans import core, operations, platform  # noqa: F401
