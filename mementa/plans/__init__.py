"""Plans: whole jobs over library snapshots and the bindings to the driver tables."""
