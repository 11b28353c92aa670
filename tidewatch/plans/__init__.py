"""tidewatch.plans."""
