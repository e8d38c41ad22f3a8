"""Operators for building training data from code findings and documents."""
