"""Part of the tessera package."""
