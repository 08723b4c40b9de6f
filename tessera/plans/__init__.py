"""From a query string to a plan."""
