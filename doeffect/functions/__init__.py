"""Column-level building blocks: rule sets, label normalisation, coherence."""
