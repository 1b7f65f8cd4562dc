"""Operators for preparing training data. Nothing else in newslens imports this subpackage."""
