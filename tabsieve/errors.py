"""Errors of the engine."""


class EngineError(Exception):
    """Any error of this engine."""


class ParseError(EngineError):
    """The text is not a query; position is where that shows."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


class AnalysisError(EngineError):
    """A name is unknown, or types do not go together."""


class CatalogError(EngineError):
    """A database or table cannot be created, opened or changed."""
