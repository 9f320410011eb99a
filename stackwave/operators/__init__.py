"""operators of the interferometric stack engine."""
