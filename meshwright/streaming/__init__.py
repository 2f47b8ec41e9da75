"""Burns of unbounded inputs."""
