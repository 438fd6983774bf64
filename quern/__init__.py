"""quern: an analytics engine for JSON-document collections on PySpark."""
