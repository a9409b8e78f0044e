"""Where observations, maps and reports are read from and written to."""
