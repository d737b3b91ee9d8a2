"""Scripts: tokens, nodes, parser, and the runner that turns them into lazy DataFrames."""
