"""Scalar values, visibility and canonical forms, as Columns."""
