"""DataFrame-to-DataFrame operators over long ``(pair, ts)`` tables."""
