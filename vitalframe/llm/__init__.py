"""Operators on texts for training data: scanned pages, value mapping, personal information, packing, mixing, subjects.

Nothing outside this subpackage imports it."""
