"""Operators for preparing text for training: nothing else in the library imports this subpackage."""
