"""Column functions: tags, text, kinds and the binary form of events."""
