"""Event operators as Structured Streaming, with the batch forms they equal."""
