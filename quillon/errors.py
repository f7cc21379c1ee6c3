"""Errors of the engine."""

from __future__ import annotations


class QuillonError(Exception):
    """Base of all errors that the engine raises itself."""


class DimensionMismatch(QuillonError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"expected vectors of {expected} elements, found {found}")
        self.expected, self.found = expected, found


class CollectionNotFound(QuillonError):
    pass


class CollectionExists(QuillonError):
    pass


class ConcurrentChange(QuillonError):
    def __init__(self, path: str):
        super().__init__(f"another writer has changed {path}")


class InvalidQuery(QuillonError):
    pass


class InvalidConfig(QuillonError, ValueError):
    pass


class InsufficientSamples(QuillonError):
    def __init__(self, needed: int, found: int):
        super().__init__(f"training needs {needed} vectors, found {found}")
        self.needed, self.found = needed, found
