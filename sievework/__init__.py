"""sievework: choosing and preparing training data with Spark."""
