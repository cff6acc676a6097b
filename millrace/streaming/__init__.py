"""The same shapes as Structured Streaming jobs."""
