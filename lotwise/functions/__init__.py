"""functions of lotwise."""
