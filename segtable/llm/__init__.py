"""Operations of a training-data pipeline over the ``documents``-like tables.

Nothing else in the library imports this subpackage.  ``registry`` holds the
thin queries that the entry module adds when the subpackage is present.
"""
