"""operators of lotwise."""
