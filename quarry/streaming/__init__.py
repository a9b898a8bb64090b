"""Incremental decoding of block streams."""
