"""Operators for training corpora: encoding, joins, filters, packing, mixing, privacy."""
