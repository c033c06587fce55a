"""Model fitting, scoring and the registered queries."""
