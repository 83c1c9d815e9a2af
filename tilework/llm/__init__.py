"""Training-data operators: packing, mixing, line and document deduplication, nearest neighbours, classifiers.

Nothing else in the library imports this subpackage.
"""
