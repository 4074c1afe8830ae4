"""DataFrame-to-DataFrame operators on long series panels."""
