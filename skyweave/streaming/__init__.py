"""streaming of the halo-stacking engine."""
