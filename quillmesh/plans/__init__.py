"""Queries over the test tables, and the pipeline that joins the operators."""
