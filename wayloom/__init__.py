"""Derived tables over graph-shaped map data, declared as Spark plans."""
