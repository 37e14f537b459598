"""Operators over texts and terms. Nothing outside of this package imports it."""
