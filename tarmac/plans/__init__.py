"""Derived road network and search kernels."""
