"""sources of lotwise."""
