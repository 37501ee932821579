"""Relational and domain operators on telemetry."""
