"""Streaming: the library kept up to date as its log grows."""
