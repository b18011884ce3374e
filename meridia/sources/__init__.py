"""Part of the spatial engine: sources."""
