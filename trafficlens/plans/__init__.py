"""Shared ways of laying out work over a cluster: slices, running totals, ordered folds."""
