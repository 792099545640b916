"""Operators that prepare training data. Nothing else in loomdex imports this subpackage."""
