"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with a general interface; ``registry``
binds them to the tables the driver knows.
"""
