"""Column builders: calendar keys, scalar rules and row frames."""
