"""sources of the interferometric stack engine."""
