"""operators of the halo-stacking engine."""
