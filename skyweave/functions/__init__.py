"""functions of the halo-stacking engine."""
