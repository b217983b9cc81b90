"""Registered queries over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from fourfold.catalog import core, more, series, space

QUERIES = core.QUERIES | series.QUERIES | space.QUERIES | more.QUERIES
SQL = core.SQL | series.SQL | space.SQL | more.SQL
