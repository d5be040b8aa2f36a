"""Relational operators over spans, votes, candidates and mappings."""
