"""streaming of the interferometric stack engine."""
