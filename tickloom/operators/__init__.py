"""Operators on bar tables. Importing the package registers all feature groups."""

from . import indicators, market  # noqa: F401
