"""All queries of the core, by name, and the SQL that they are checked against."""

from __future__ import annotations

from . import core, core_sql, data, views

QUERIES = core.QUERIES | views.QUERIES | data.QUERIES
SQL = core_sql.SQL | views.SQL | data.SQL
