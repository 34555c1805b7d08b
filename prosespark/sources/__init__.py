"""Sources and sinks with fixed schemas."""
