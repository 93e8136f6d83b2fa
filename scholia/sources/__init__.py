"""Table schemas, inputs and outputs."""
