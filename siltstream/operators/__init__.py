"""operators of the delivery engine."""
