"""Stateful streams: a bounded store, a decayed state, and commits diffed as they arrive."""
