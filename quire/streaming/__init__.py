"""File streams: what was pending is processed once, in bounded steps."""
