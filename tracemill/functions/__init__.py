"""Part of tracemill."""
