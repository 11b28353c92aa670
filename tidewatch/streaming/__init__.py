"""tidewatch.streaming."""
