"""Registered queries over the driver tables, each with its SQL oracle where one exists."""
