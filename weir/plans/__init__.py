"""Whole plans built from the operators, and the contract queries."""
