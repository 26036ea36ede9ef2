"""Analytics for coded-video streams and encoder telemetry on Spark."""
