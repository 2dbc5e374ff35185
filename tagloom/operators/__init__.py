"""Relational operators: paging, reports, matching, vocabulary, consolidation."""
