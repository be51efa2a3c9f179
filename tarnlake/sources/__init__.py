"""Loaders, readers and sinks."""
