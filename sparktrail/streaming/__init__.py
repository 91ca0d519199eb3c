"""Rules over unbounded traces: an automaton a case, kept as streaming state."""
