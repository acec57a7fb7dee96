"""DataFrame operators of the linkage engine."""
