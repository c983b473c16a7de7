"""The registry of queries and of the SQL that each must agree with."""

from __future__ import annotations

from lectern.plans import citations, landing, relational, search, styled, texts

FLAGSHIP = "hybrid_search"
QUERIES = relational.QUERIES | texts.QUERIES | citations.QUERIES | styled.QUERIES | landing.QUERIES | search.QUERIES
ORACLE = relational.ORACLE | texts.ORACLE | citations.ORACLE | styled.ORACLE | landing.ORACLE | search.ORACLE
