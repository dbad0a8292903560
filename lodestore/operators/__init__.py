"""DataFrame operators: search, mutation, index topology, statistics, text building."""
