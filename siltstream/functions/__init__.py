"""functions of the delivery engine."""
