"""Operation lists folded into one lazy DataFrame plan, and the registered
queries over the test tables."""
