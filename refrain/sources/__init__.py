"""Sources: adapters that turn inputs into the canonical ``messages`` DataFrame."""
