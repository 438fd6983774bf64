"""Requests, validated into specs, and the planner that turns a spec into a lazy DataFrame."""
