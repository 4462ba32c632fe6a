"""Operators for building training corpora out of image records and page texts."""
