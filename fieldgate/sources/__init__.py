"""Packet directories, truth files, caches and packets rendered from relational tables."""
