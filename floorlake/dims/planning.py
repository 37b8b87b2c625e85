"""Planning rules: which subsystem leads to which action, priors, ordering and exclusion."""

from . import define

# Action types.
ACTION_TYPES = [
    "material_adjustment", "lighting_adjustment", "palette_adjustment", "asset_replacement",
    "asset_variant_swap", "decor_density", "furniture_rotation", "furniture_translation",
    "furniture_scale_refinement", "camera_correction", "style_refinement",
]
# Subsystem -> action type.
SUBSYSTEM_ACTIONS = [
    ("LightingEnvironment", "lighting_adjustment"), ("LightSource", "lighting_adjustment"),
    ("ColourPalette", "palette_adjustment"), ("SurfaceFinish", "material_adjustment"),
    ("MaterialSpecies", "material_adjustment"), ("SceneGraphTransform", "furniture_translation"),
    ("AssetPlacement", "asset_replacement"), ("ObjectDetection", "decor_density"),
    ("CameraFit", "camera_correction"),
]
# Subsystems nothing may be changed for.
UNACTIONABLE = [
    ("Geometry", "DXF geometry is immutable"),
    ("RenderSettings", "the optimiser must not tune the instrument that scores it"),
]
# How much of the headroom each action type is expected to win.
EFFICACY = [
    ("lighting_adjustment", 0.7), ("palette_adjustment", 0.45), ("material_adjustment", 0.5),
    ("camera_correction", 0.8), ("furniture_translation", 0.55), ("furniture_rotation", 0.35),
    ("furniture_scale_refinement", 0.3), ("asset_replacement", 0.4), ("asset_variant_swap", 0.25),
    ("decor_density", 0.45), ("style_refinement", 0.35),
]
# Action type that must come first -> action type that follows.
ORDERING = [
    ("camera_correction", "furniture_translation"), ("camera_correction", "furniture_rotation"),
    ("camera_correction", "furniture_scale_refinement"), ("style_refinement", "material_adjustment"),
    ("style_refinement", "palette_adjustment"), ("style_refinement", "asset_replacement"),
    ("palette_adjustment", "material_adjustment"), ("asset_replacement", "furniture_scale_refinement"),
    ("decor_density", "furniture_translation"),
]
# Pairs of types of which only one may act on a target.
EXCLUSIVE = [
    ("asset_replacement", "asset_variant_swap"), ("asset_replacement", "furniture_scale_refinement"),
    ("asset_variant_swap", "furniture_scale_refinement"),
]

define("dim_action_types", "action_type", [(t,) for t in ACTION_TYPES])
define("dim_subsystem_actions", "subsystem action_type", SUBSYSTEM_ACTIONS)
define("dim_unactionable", "subsystem reason", UNACTIONABLE)
define("dim_efficacy", "action_type efficacy", EFFICACY)
define("dim_ordering", "earlier_type later_type", ORDERING)
define("dim_exclusive", "left_type right_type", EXCLUSIVE)
