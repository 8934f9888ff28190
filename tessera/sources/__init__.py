"""Named splits and run logs as files."""
