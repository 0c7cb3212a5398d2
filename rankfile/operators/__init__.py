"""Chess rules in lockstep over many games, lexing, and the replay operator."""
