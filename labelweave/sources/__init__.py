"""Readers, writers and samples."""
