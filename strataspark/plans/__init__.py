"""Rewrites made while a plan is composed, where Catalyst would choose a nested loop."""
