"""Labelling of arriving rows with a fixed model."""
