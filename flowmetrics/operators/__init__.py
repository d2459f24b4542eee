"""DataFrame -> DataFrame analytic operators."""
