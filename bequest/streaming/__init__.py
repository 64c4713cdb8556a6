"""Structured Streaming jobs: the streamed twins of the validators and transitions."""
