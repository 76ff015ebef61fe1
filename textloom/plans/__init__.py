"""From a query's tree to a DataFrame plan."""
