"""The one exception that statements raise."""


class EngineError(Exception):
    """A statement that can't be parsed, planned or carried out; nothing has changed."""
