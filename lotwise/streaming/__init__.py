"""streaming of lotwise."""
