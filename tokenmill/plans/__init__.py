"""Derived inputs (fixtures) and the registered query catalog."""
