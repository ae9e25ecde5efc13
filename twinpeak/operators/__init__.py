"""DataFrame operators: joins, traces, picking, ordering, comparison, statistics."""
