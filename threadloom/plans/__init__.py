"""Whole plans: index building, query batches and the registered queries."""
