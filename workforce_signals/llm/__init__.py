"""Operators for preparing training data: sharding, tokens, decontamination, quality, extraction, language,
near duplicates, nearest neighbours and personal data.

Nothing else in the library imports this subpackage.
"""
