"""DataFrame operators on traces, graphs, systems, rules and evaluation results."""
