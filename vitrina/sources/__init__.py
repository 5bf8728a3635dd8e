"""Readers, writers and extractors that turn fetched material into tables."""
