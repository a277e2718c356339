"""Package operators of tidebook."""
