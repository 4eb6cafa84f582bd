"""Register declarations, scans, delivery listings, the source catalogue and the sinks."""
