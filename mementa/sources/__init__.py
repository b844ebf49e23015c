"""Sources: loaders that produce inventory, payload and image tables."""
