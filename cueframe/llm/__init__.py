"""Operators for large training corpora: one module per operator, each a set of
functions from DataFrame to DataFrame.  ``entry`` lists their queries."""
