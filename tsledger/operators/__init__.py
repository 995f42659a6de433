"""Operators over logs and points, as DataFrame plans."""
