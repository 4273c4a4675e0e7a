"""Sources, sinks and naming rules."""
