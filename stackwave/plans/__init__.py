"""plans of the interferometric stack engine."""
