"""All queries of the point operators, and their SQL."""

from __future__ import annotations

from pointlake.plans import file_cases, point_cases, projection_cases, surface_cases, tool_cases, workflow_cases

_CASES = (point_cases, tool_cases, surface_cases, workflow_cases, file_cases, projection_cases)
QUERIES = {name: query for cases in _CASES for name, query in cases.QUERIES.items()}
ORACLE_SQL = {name: sql for cases in _CASES for name, sql in cases.ORACLE_SQL.items()}
