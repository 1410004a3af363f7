"""Plans made of several operators: factor graphs, pipelines, strategies, backtests, sweeps."""
