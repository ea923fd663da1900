"""Query plans that choose among operators, and renderers."""
