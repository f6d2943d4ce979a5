"""All core queries by name, with their SQL where SQL can express them."""

from kinmesh.plans import heavy, pipelines, quality, relational, reviews, roundtrips, texts

FLAGSHIP = "precision_recall_ids"
MODULES = (heavy, relational, quality, texts, pipelines, reviews, roundtrips)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
