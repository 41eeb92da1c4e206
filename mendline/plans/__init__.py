"""From two sides' headers to a plan, its execution, and what there is to report."""
