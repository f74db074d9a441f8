"""DataFrame operators: each takes and returns DataFrames, no actions inside
except the size checks of broadcast sides."""
