"""Sources of the narratum engine."""
