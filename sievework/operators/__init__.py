"""sievework.operators."""
