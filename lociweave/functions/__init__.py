"""Column expressions and plain kernels."""
