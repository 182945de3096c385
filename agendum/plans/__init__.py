"""Operators put together: the flagship plan and the query catalogue."""
