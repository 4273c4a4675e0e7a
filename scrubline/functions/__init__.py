"""Column functions: everything that Catalyst can evaluate, and the Arrow functions for what it can't."""
