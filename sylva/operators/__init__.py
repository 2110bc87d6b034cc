"""DataFrame operators of forest learning: sampling, statistics, splits, routing, votes and errors."""
