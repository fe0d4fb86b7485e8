"""Streaming of the narratum engine."""
