"""Queries over the standard tables, each with the SQL that gives the same rows."""

from . import analysis, dense, etl, fusion, lexical, metrics, more, readiness, scalars, streams
from .registry import ORACLE, QUERIES

MODULES = (analysis, dense, etl, fusion, lexical, metrics, more, readiness, scalars, streams)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
