"""Axis weights and scoring constants."""

from . import define

# The five axes, their order and default weights.
AXES = ["colour", "material", "lighting", "layout", "objects"]
AXIS_WEIGHTS = [("colour", 0.20), ("material", 0.15), ("lighting", 0.20), ("layout", 0.20), ("objects", 0.25)]
# The weights of the pairwise picture comparison.
PAIR_WEIGHTS = [("colour", 0.26), ("material", 0.20), ("lighting", 0.24), ("layout", 0.22), ("objects", 0.08)]

define("dim_axis_weights", "axis weight", AXIS_WEIGHTS)
define("dim_pair_weights", "axis weight", PAIR_WEIGHTS)
