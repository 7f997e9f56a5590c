"""Plan helpers and the queries of the core."""
