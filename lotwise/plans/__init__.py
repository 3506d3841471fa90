"""plans of lotwise."""
