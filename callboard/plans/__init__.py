"""The jobs, built from the operators."""
