"""Training-data operators over text corpora.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
