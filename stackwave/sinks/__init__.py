"""sinks of the interferometric stack engine."""
