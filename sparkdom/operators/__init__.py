"""Operators over tables of pages and of nodes."""
