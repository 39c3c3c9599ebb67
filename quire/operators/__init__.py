"""DataFrame-in, DataFrame-out operators over page, document and job tables."""
