"""Sources, sinks and pipeline state."""
