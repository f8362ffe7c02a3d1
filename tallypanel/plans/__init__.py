"""The jobs and the query catalog."""
