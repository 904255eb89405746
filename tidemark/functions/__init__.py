"""Part of the point-in-time feature library."""
