"""Sources, stored state and sinks."""
