"""Sources, sinks and derived panels."""
