"""Column helpers, ranks and quantiles shared by the operators."""
