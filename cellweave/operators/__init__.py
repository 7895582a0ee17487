"""Relational operators: virtual cells, contexts, pairs, filtering, graphs, evaluation, statistics."""
