"""Multi-step commands composed of operators, and the registry of named queries."""
