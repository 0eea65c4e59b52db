"""sources of the halo-stacking engine."""
