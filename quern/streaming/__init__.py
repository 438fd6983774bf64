"""The change feed and idle expiry on Structured Streaming."""
