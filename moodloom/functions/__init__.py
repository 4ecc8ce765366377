"""functions of the package."""
