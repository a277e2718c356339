"""Package sources of tidebook."""
