"""Column functions: text keys, field-type rules, vectors."""
