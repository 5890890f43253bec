"""Sources: universe lists and stored tables."""
