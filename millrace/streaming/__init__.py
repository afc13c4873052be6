"""Tables that arrive in batches: Structured Streaming around the batch operators."""
