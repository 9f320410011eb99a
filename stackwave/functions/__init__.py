"""functions of the interferometric stack engine."""
