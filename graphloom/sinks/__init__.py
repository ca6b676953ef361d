"""Exports of a graph."""
