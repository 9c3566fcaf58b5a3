"""Operators for preparing training text; nothing else in the library imports this subpackage.

Every operator reads only the columns it names, so other columns of its input, whatever they are
called, neither matter nor come back.
"""
