"""Errors that a caller can answer with a message."""


class QuestionError(ValueError):
    """A question, request or change that can't be carried out as asked."""


class Forbidden(PermissionError):
    """The user may not see what was asked for."""
