"""All queries of the core library."""

from __future__ import annotations

from draftlake.plans import catalog, drawings, exports, problems

QUERIES = problems.QUERIES | catalog.QUERIES | drawings.QUERIES | exports.QUERIES
SQL = problems.SQL | catalog.SQL | drawings.SQL | exports.SQL
