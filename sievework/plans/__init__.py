"""sievework.plans."""
