"""Where graphs come from and go to: Turtle files, relational test tables, metrics, event logs."""
