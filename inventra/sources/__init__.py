"""Sources and the bridge to test tables."""
