"""Plans of the narratum engine."""
