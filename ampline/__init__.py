"""Appliance-switch events from electrical load signals, on Spark."""
