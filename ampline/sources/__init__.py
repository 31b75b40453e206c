"""Sources and sinks of samples and results."""
