"""DataFrame operators over memory graphs."""
