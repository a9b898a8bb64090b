"""Queries over the block format, and the SQL they are held against."""
