"""Operators that prepare a corpus for training language models.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``queries`` derives the registered results.
"""
