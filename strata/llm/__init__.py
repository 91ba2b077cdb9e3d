"""Operators for preparing text corpora (see the README section "Corpus
operators"). Nothing else in the library imports this subpackage."""
