"""Operators for preparing large text corpora, each by one named method."""
