"""Training plans, fitted models and the registered queries."""
