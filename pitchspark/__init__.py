"""Batch jobs for football-scouting data at scale, as DataFrame operators."""
