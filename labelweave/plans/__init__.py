"""Composed plans: clustering, loops and the registered queries."""
