"""Spark-native halo stacking: particles to fields, maps, selections, profiles and spectra."""
