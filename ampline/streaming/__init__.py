"""Sequential detection: the per-stream kernel, in batch and in Structured Streaming."""
