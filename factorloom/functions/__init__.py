"""See the module docstrings; the README maps them to the survey."""
