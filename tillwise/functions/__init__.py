"""Column expressions: all but the network's run inside whole-stage codegen."""
