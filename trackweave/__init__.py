"""Sports-tracking analytics on Spark: detections, scoreboard reads and play-by-play logs as relations."""
