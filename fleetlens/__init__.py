"""fleetlens: health analytics over the snapshot history of a fleet of distributed SQL databases."""
