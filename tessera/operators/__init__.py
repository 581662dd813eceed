"""Table operators: change, constraints, retention, procedures."""
