"""Image classes and trust tiers."""

from . import define

# Image class, analysis mode, trust in its geometry.
IMAGE_CLASSES = [
    ("interior_photograph", "full", 0.85), ("interior_render", "full", 0.55), ("room_render", "full", 0.55), ("furnished_floorplan", "layout", 0.7),
    ("top_down_layout", "layout", 0.7), ("cad_drawing", "geometry", 0.95), ("wireframe", "geometry", 0.95), ("architectural_elevation", "geometry", 0.6),
    ("exterior_render", "skip", 0.0), ("site_plan", "skip", 0.0), ("unknown", "full", 0.5),
]
# Classes that only show geometry.
GEOMETRY_ONLY = ["cad_drawing", "wireframe", "architectural_elevation"]
# Other names for image classes, first one contained wins.
CLASS_ALIASES = [
    ("photograph", "interior_photograph"), ("photo", "interior_photograph"), ("interior_photo", "interior_photograph"), ("render", "interior_render"),
    ("rendering", "interior_render"), ("architectural_render", "interior_render"), ("3d_render", "interior_render"), ("living_room_render", "room_render"),
    ("bedroom_render", "room_render"), ("kitchen_render", "room_render"), ("bathroom_render", "room_render"), ("floor_plan", "furnished_floorplan"),
    ("floorplan", "furnished_floorplan"), ("furnished_floor_plan", "furnished_floorplan"), ("top_view", "top_down_layout"), ("top_down", "top_down_layout"),
    ("plan_view", "top_down_layout"), ("isometric", "top_down_layout"), ("cad", "cad_drawing"), ("cad_screenshot", "cad_drawing"), ("blueprint", "cad_drawing"),
    ("line_drawing", "wireframe"), ("elevation", "architectural_elevation"), ("section", "architectural_elevation"), ("exterior", "exterior_render"), ("facade", "exterior_render"),
]
# Where a fact came from, most trusted first.
SOURCE_TIERS = [("user", 0), ("cad_metadata", 1), ("cad_block", 2), ("cad_layer", 3), ("cad_text", 4), ("cad_geometry", 5), ("image", 6), ("reasoning", 7)]
# Registration methods, best first.
METHOD_RANKS = [("label_consensus", 0), ("single_anchor", 1), ("plan_bounds", 2), ("none", 3)]

define("dim_image_classes", "image_class mode trust", IMAGE_CLASSES)
define("dim_source_tiers", "source tier", SOURCE_TIERS)
define("dim_method_ranks", "method rank", METHOD_RANKS)
