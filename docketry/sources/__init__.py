"""Readers and writers for registries, statements, target lists, partitions and products."""
