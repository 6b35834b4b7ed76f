"""Sources: feeds and item lists from a landing zone."""
