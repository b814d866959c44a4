"""Scalar expressions over model columns, all of built-in functions."""
