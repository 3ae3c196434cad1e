"""Indexes that follow a folder of files, and queries that follow an index."""
