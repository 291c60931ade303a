"""Event-time windows, sessions and state, over tables and over streams."""
