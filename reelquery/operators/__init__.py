"""DataFrame-level operators: temporal windows, k-NN, ranking, store."""
