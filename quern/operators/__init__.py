"""The relational operators: projection, sorting, joins, metrics and mutations."""
