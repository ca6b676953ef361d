"""From Python and Markdown sources to a graph: facts of each file by the standard parser, then names resolved by joins."""
