"""Sources and sinks: panels, providers, stores, option chains."""
