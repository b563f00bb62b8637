"""Scalar functions: identifier grammar, source lines, globs and terminal-safe text."""
