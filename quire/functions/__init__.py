"""Pure Column-to-Column functions."""
