"""Operators for preparing training text: fingerprints, packing, tokens, joins, chat, filters, scans and scores."""
