"""All registered queries over the given tables, and their oracle SQL."""

from korpusflow.plans import corpus, lifecycle, retrieval, rules, structure

QUERIES = retrieval.QUERIES | corpus.QUERIES | rules.QUERIES | structure.QUERIES | lifecycle.QUERIES
ORACLES = retrieval.ORACLES | corpus.ORACLES | rules.ORACLES | structure.ORACLES | lifecycle.ORACLES
