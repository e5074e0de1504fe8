"""Errors that a caller can show to a user."""


class InputError(ValueError):
    """A parameter, a column or the data doesn't allow the operation."""
