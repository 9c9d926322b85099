"""Streaming forms: a drop folder of pictures, lines of requests, and event-time statistics of runs."""
