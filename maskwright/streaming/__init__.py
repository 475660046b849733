"""Jobs as a stream."""
