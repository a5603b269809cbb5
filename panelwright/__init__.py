"""Panel signal research on Spark: features, labels, splits, scores, portfolios."""
