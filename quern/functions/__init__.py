"""Column builders: field paths, predicates, JSON Schema checks and formats."""
