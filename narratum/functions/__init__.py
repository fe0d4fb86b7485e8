"""Functions of the narratum engine."""
