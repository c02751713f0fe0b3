"""Jobs over the canonical tables. Every function takes and returns DataFrames."""
