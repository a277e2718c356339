"""Package streaming of tidebook."""
