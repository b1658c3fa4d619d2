"""Scholarly-record analytics on Spark."""
