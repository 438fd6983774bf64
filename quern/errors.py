"""Errors that a request can meet, with the status of their envelope."""

from __future__ import annotations


class RequestError(Exception):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.message, self.status = message, status

    def envelope(self) -> dict:
        return {"error": self.message, "statusCode": self.status}


class NotFound(RequestError):
    def __init__(self, message: str = "No documents found"):
        super().__init__(message, 404)


class Conflict(RequestError):
    def __init__(self, message: str = "Version conflict"):
        super().__init__(message, 409)


class Forbidden(RequestError):
    def __init__(self, message: str = "Not allowed"):
        super().__init__(message, 403)
