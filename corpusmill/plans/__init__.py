"""From a configuration to a plan: settings, strategies, preparation."""
