"""See the package docstring of loomwright."""
