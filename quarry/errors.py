"""Exceptions of the block engine."""


class BlockError(ValueError):
    """Base of all errors about blocks, types and frames."""


class NeedMore(BlockError):
    """The input ends inside a value: more bytes may complete it.

    ``at`` is a length that the input must have at least before another try gets any further; 0 if that is not known.
    """

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


class UnsupportedType(BlockError):
    """A type name that is unknown, illegal or has no codec."""


class UnsupportedRevision(BlockError):
    """A protocol revision above the newest known."""


class InvalidBlockInfo(BlockError):
    """A malformed preamble, or one of its fields twice."""


class UnsupportedSerialization(BlockError):
    """A custom serialization marker or state word that has no codec."""


class SchemaMismatch(BlockError):
    """A later block's schema differs from the first one's."""


class InvalidData(BlockError):
    """Column data that contradicts its type."""


class ResourceLimit(BlockError):
    """A declared size above a limit."""


class InconsistentBatch(BlockError):
    """A batch that can't be encoded under its declared types."""


class CompressionError(BlockError):
    """A malformed, truncated or corrupted compression frame."""


class ProtocolError(BlockError):
    """Bytes or calls that the packet protocol does not allow here."""
