"""Models behind an interface, with deterministic ones that need no network."""
