"""Column expressions: times, text, angles, positions, scaling, digests."""
