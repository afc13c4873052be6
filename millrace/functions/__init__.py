"""Column expressions and aggregates with the engine's exact semantics."""
