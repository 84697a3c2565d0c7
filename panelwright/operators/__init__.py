"""DataFrame operators, one module per topic."""
