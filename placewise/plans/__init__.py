"""Registered queries over the driver's tables and their SQL twins."""

from . import landed  # noqa: F401  (registers its queries)
