"""Live forms of the windowing operators."""
