"""Readers and projections that produce scans, peaks and targets."""
