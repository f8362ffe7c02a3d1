"""DataFrame to DataFrame operators; keys, day column and metrics are parameters."""
