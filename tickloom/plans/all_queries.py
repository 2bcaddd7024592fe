"""Collects the registered queries of all modules."""

from __future__ import annotations

from . import q_data, q_eval, q_features, q_flagship, q_models, q_stream, q_trading, q_windows  # noqa: F401
from .catalog import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
