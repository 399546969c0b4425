"""The queries and SQL of this subpackage, gathered from its modules."""

from . import bpe, colloc, decontam, jaccard, knn, langid, lines, negatives, packing, quality, repeats, sharding, toxicity

MODULES = (bpe, colloc, decontam, jaccard, knn, langid, lines, negatives, packing, quality, repeats, sharding, toxicity)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
