"""Column functions: states, algebra, lattice, nested and parallel channels, scores, checks."""
