"""Errors of the library."""


class TextloomError(Exception):
    """Any error raised here."""


class LoadError(TextloomError):
    """A dictionary or cache cannot be read."""


class SaveError(TextloomError):
    """A dictionary or cache cannot be written."""


class PredictionError(TextloomError):
    """A tag cannot be predicted from the given models."""
