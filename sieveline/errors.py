"""Errors of the engine."""


class EngineError(Exception):
    """Base of all."""


class IndexStaleError(EngineError):
    """The index is being built, or an interrupted build left it incomplete."""


class IndexMissingError(EngineError):
    """No index has been built."""


class EmbeddingDimensionError(EngineError):
    """A vector has not the index's dimensions."""


class ScoreColumnError(EngineError):
    """A hit has no score column."""


class SearchError(EngineError):
    """The query is invalid."""


class ConfigError(EngineError):
    """The configuration is invalid."""


class WriteConflictError(EngineError):
    """Another writer changed the relation in the meantime; what was staged isn't part of it."""
