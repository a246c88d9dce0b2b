"""Operators that prepare text corpora for training; optional part of the library."""
