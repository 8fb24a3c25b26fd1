"""Empty by intent: source files come as yearly releases, and no analysis here is defined over a stream."""
