"""Graph operators and reports over node and edge DataFrames."""
