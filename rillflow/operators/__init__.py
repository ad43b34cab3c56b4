"""Operators: DataFrame in, DataFrame out, lazy; keys begin with ``scenario`` so that all scenarios are one job."""
