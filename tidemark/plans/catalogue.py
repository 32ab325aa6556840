"""All queries of the library with their SQL."""

from __future__ import annotations

from tidemark.plans import documents, findings, jobs, market, profile, records, retrieval, scoring, sections, sources, statements

QUERIES: dict = {**market.QUERIES, **retrieval.QUERIES, **scoring.QUERIES, **profile.QUERIES, **documents.QUERIES, **records.QUERIES, **statements.QUERIES, **findings.QUERIES, **jobs.QUERIES, **sources.QUERIES, **sections.QUERIES}
ORACLE: dict[str, str] = {**market.ORACLE, **retrieval.ORACLE, **scoring.ORACLE, **profile.ORACLE, **documents.ORACLE, **records.ORACLE, **statements.ORACLE, **findings.ORACLE, **jobs.ORACLE, **sources.ORACLE, **sections.ORACLE}
FLAGSHIP = "event_heat_features"
