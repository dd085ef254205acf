"""Queries of the core operators with their SQL, by theme."""
