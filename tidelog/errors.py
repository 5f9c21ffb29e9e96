"""Errors of the recording engine."""


class TidelogError(Exception):
    """Base of all errors here."""


class UnexpectedEnd(TidelogError):
    """A payload or file ends before a value does."""


class CorruptFile(TidelogError):
    """A chunk's check sum doesn't fit its records."""


class InvalidDefinition(TidelogError):
    """A message definition can't be read."""


class UnresolvedType(TidelogError):
    """A definition names a type that isn't there."""


class UnsupportedEncoding(TidelogError):
    """No codec for this message or schema encoding."""


class UnsupportedFormat(TidelogError):
    """No reader or writer for this format here."""


class IncompatibleType(TidelogError):
    """Two schemas can't be merged."""


class TableExists(TidelogError):
    """A table is there already, and the mode is error."""


class TableNotFound(TidelogError):
    """A named table isn't there."""


class NameClash(TidelogError):
    """Columns would have one name."""


class SqlRejected(TidelogError):
    """SQL that Spark would read with another meaning."""
