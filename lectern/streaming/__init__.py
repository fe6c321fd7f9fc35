"""The same plans over folders that files keep arriving in."""
