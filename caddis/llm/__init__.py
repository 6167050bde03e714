"""Operators for training data: text, matching and ranking. Nothing else in the library imports this subpackage."""
