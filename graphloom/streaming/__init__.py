"""Watching a folder of sources as a stream."""
