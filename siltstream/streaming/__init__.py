"""streaming of the delivery engine."""
