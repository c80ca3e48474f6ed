"""Table loaders, connectors and static relations."""
