"""Package functions of tidebook."""
