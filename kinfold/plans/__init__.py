"""Driver-side plans: configuration and the resolve loop."""
