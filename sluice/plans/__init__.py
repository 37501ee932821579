"""Whole plans: the feature matrix, read views, and the registered queries."""
