"""Column expressions and small distributed building blocks shared by the
operators (statistics, size-checked joins, global ordinals)."""
