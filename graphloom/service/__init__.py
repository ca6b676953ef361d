"""Answers to single questions, in a process that keeps a graph at hand."""
