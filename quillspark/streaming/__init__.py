"""Change streams and incremental maintenance."""
