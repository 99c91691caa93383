"""Operators for building training corpora: filtering, de-duplication, scoring, mixing and packing of documents."""
