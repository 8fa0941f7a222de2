"""Evidence-weighted graph and hybrid retrieval dataflows as Spark plans."""
