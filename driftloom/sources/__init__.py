"""Readers for the tables the operators work on."""
