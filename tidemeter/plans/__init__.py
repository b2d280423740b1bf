"""Multi-operator plans: the incrementally maintained usage tables and the published report."""
