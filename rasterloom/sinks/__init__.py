"""File formats written by the engine."""
