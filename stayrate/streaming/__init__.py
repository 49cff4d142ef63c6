"""Scoring of arriving customer rows."""
