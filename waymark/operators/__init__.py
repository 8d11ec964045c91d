"""DataFrame operators: joins, search, evaluation, re-ranking, statistics."""
