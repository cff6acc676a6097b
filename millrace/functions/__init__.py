"""Column-level building blocks: exact money, numeric kernels, user functions."""
