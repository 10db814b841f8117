"""Operations on text corpora for training data: scoring, packing, joins, filters, scans.

Nothing else in the library imports this subpackage.
"""
