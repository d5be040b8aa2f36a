"""Reversible masking of confidential terms over text corpora, planned by Spark."""
