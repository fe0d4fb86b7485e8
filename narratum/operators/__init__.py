"""Operators of the narratum engine."""
