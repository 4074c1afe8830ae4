"""All queries of the package, by name, and their SQL."""

from __future__ import annotations

from freshet.plans import comparison_queries, domain_queries, feature_queries, report_queries, signature_queries, skill_queries

MODULES = [signature_queries, skill_queries, feature_queries, domain_queries, comparison_queries, report_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
