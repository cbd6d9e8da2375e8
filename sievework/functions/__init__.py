"""sievework.functions."""
