"""Operators for preparing training data at cluster scale.  Nothing outside this folder imports it."""
