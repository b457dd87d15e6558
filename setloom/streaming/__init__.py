"""No streams: sets are immutable and queries are batch, so this package is empty on purpose."""
