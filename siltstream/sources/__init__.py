"""sources of the delivery engine."""
