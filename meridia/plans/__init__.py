"""Part of the spatial engine: plans."""
