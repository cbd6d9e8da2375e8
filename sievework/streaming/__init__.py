"""sievework.streaming."""
