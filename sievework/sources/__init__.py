"""sievework.sources."""
