"""DataFrame -> DataFrame operators.  No operator runs an action."""
