"""Queries over the star-schema tables, by the operators they exercise, with equivalent SQL."""

from rankloom.queries import curation, evaluation, evidence, lookups, ranking, reviews, sources, study, texts

QUERIES = {}
ORACLE_SQL = {}
for module in (evidence, ranking, evaluation, sources, reviews, texts, lookups, study, curation):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
