"""Evidence analytics on Spark: extraction, identity, coverage, decisions."""
