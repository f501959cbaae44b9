"""Composed queries: the search and graph services and the query catalogue."""
