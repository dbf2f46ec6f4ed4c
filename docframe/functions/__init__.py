"""Column-to-Column helpers; usable in batch and streaming projections."""
