"""Errors raised by the library."""


class StayrateError(Exception):
    """Base of all errors raised here."""


class InputError(StayrateError):
    """The given data cannot be processed (empty, missing or wrongly typed columns)."""


class OptionError(StayrateError):
    """An argument has a value that is not supported."""


class NotFittedError(StayrateError):
    """Parameters were used, or saved, before they were fitted."""


class CleaningError(StayrateError):
    """Cleaning could not be completed."""


class StorageError(StayrateError):
    """A table, file or saved object is missing or cannot be read or written."""
