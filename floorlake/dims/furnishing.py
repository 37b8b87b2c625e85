"""What a room of a type holds, and how a style changes materials and light."""

from . import define

# Room type, category, smallest area, count, m2 per extra, most, importance, requires, relation, its target, stands on a surface.
FURNITURE = [
    ("bedroom", "bed", 7.0, 1, 0.0, 1, 1.0, "", "", "", False),
    ("bedroom", "bedside_table", 8.5, 1, 6.0, 2, 0.8, "bed", "beside", "bed", False),
    ("bedroom", "wardrobe", 9.0, 1, 0.0, 1, 0.75, "", "", "", False),
    ("bedroom", "study_table", 15.0, 1, 0.0, 1, 0.4, "", "", "", False),
    ("bedroom", "office_chair", 16.0, 1, 0.0, 1, 0.35, "study_table", "faces", "study_table", False),
    ("bedroom", "armchair", 20.0, 1, 0.0, 1, 0.3, "", "", "", False),
    ("bedroom", "rug", 12.0, 1, 0.0, 1, 0.25, "", "", "", False),
    ("bedroom", "plant", 14.0, 1, 0.0, 1, 0.15, "", "", "", False),
    ("living_room", "sofa", 12.0, 1, 0.0, 1, 1.0, "", "", "", False),
    ("living_room", "coffee_table", 14.0, 1, 0.0, 1, 0.8, "", "faces", "sofa", False),
    ("living_room", "tv_unit", 13.0, 1, 0.0, 1, 0.75, "", "", "", False),
    ("living_room", "tv", 13.0, 1, 0.0, 1, 0.7, "tv_unit", "", "", False),
    ("living_room", "armchair", 18.0, 1, 12.0, 2, 0.5, "", "", "", False),
    ("living_room", "rug", 15.0, 1, 0.0, 1, 0.4, "coffee_table", "centered_under", "coffee_table", False),
    ("living_room", "side_table", 20.0, 1, 0.0, 1, 0.3, "", "", "", False),
    ("living_room", "bookshelf", 22.0, 1, 0.0, 1, 0.3, "", "", "", False),
    ("living_room", "plant", 16.0, 1, 18.0, 3, 0.25, "", "", "", False),
    ("living_room", "painting", 14.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("dining_room", "dining_table", 7.0, 1, 0.0, 1, 1.0, "", "", "", False),
    ("dining_room", "dining_chair", 7.0, 4, 6.0, 8, 0.9, "dining_table", "surrounds", "dining_table", False),
    ("dining_room", "sideboard", 14.0, 1, 0.0, 1, 0.4, "", "", "", False),
    ("dining_room", "rug", 14.0, 1, 0.0, 1, 0.25, "dining_table", "centered_under", "dining_table", False),
    ("dining_room", "plant", 12.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("kitchen", "kitchen_counter", 4.0, 1, 8.0, 3, 1.0, "", "", "", False),
    ("kitchen", "refrigerator", 6.0, 1, 0.0, 1, 0.85, "", "", "", False),
    ("kitchen", "oven", 7.0, 1, 0.0, 1, 0.6, "", "", "", False),
    ("kitchen", "kitchen_island", 16.0, 1, 0.0, 1, 0.5, "", "", "", False),
    ("kitchen", "stool", 18.0, 2, 8.0, 4, 0.3, "kitchen_island", "surrounds", "kitchen_island", False),
    ("kitchen", "microwave", 8.0, 1, 0.0, 1, 0.25, "kitchen_counter", "on_top_of", "kitchen_counter", True),
    ("office", "study_table", 5.0, 1, 0.0, 1, 1.0, "", "", "", False),
    ("office", "office_chair", 5.0, 1, 0.0, 1, 0.9, "study_table", "faces", "study_table", False),
    ("office", "bookshelf", 8.0, 1, 8.0, 2, 0.6, "", "", "", False),
    ("office", "cabinet", 12.0, 1, 0.0, 1, 0.35, "", "", "", False),
    ("office", "monitor", 6.0, 1, 0.0, 1, 0.3, "study_table", "on_top_of", "study_table", True),
    ("office", "plant", 10.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("office", "rug", 12.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("bathroom", "cabinet", 3.5, 1, 0.0, 1, 0.5, "", "", "", False),
    ("bathroom", "mirror", 2.5, 1, 0.0, 1, 0.4, "", "", "", False),
    ("hallway", "console_table", 6.0, 1, 0.0, 1, 0.5, "", "", "", False),
    ("hallway", "mirror", 5.0, 1, 0.0, 1, 0.35, "", "", "", False),
    ("hallway", "rug", 6.0, 1, 0.0, 1, 0.3, "", "", "", False),
    ("hallway", "plant", 7.0, 1, 0.0, 1, 0.25, "", "", "", False),
    ("hallway", "painting", 5.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("studio", "bed", 15.0, 1, 0.0, 1, 1.0, "", "", "", False),
    ("studio", "sofa", 20.0, 1, 0.0, 1, 0.8, "", "", "", False),
    ("studio", "dining_table", 18.0, 1, 0.0, 1, 0.6, "", "", "", False),
    ("studio", "dining_chair", 18.0, 2, 8.0, 4, 0.5, "dining_table", "surrounds", "dining_table", False),
    ("studio", "wardrobe", 18.0, 1, 0.0, 1, 0.6, "", "", "", False),
    ("studio", "kitchen_counter", 16.0, 1, 0.0, 1, 0.5, "", "", "", False),
    ("studio", "coffee_table", 22.0, 1, 0.0, 1, 0.4, "", "faces", "sofa", False),
    ("studio", "rug", 20.0, 1, 0.0, 1, 0.25, "", "", "", False),
    ("studio", "plant", 18.0, 1, 0.0, 1, 0.2, "", "", "", False),
    ("balcony", "chair", 3.0, 2, 6.0, 4, 0.6, "", "", "", False),
    ("balcony", "side_table", 4.0, 1, 0.0, 1, 0.5, "", "", "", False),
    ("balcony", "plant", 2.0, 2, 4.0, 6, 0.45, "", "", "", False),
    ("utility", "washing_machine", 2.5, 1, 0.0, 1, 0.9, "", "", "", False),
    ("utility", "cabinet", 4.0, 1, 5.0, 2, 0.5, "", "", "", False),
    ("utility", "shelves", 5.0, 1, 0.0, 1, 0.35, "", "", "", False),
    ("store", "shelves", 1.5, 1, 4.0, 3, 0.8, "", "", "", False),
    ("store", "cabinet", 4.0, 1, 0.0, 1, 0.4, "", "", "", False),
    ("garage", "cabinet", 15.0, 1, 15.0, 2, 0.4, "", "", "", False),
    ("garage", "shelves", 14.0, 1, 0.0, 1, 0.3, "", "", "", False),
]
# Room type, light kind, smallest area, count, m2 per extra, most, requires.
LIGHTING = [
    ("bedroom", "ceiling_light", 0.0, 1, 18.0, 2, ""), ("bedroom", "table_lamp", 8.5, 1, 6.0, 2, "bedside_table"),
    ("living_room", "ceiling_light", 0.0, 1, 16.0, 3, ""), ("living_room", "floor_lamp", 18.0, 1, 20.0, 2, ""),
    ("dining_room", "pendant_light", 0.0, 1, 14.0, 2, ""), ("kitchen", "ceiling_light", 0.0, 1, 10.0, 2, ""),
    ("kitchen", "recessed_light", 8.0, 2, 5.0, 6, ""), ("office", "ceiling_light", 0.0, 1, 0.0, 1, ""),
    ("office", "table_lamp", 6.0, 1, 0.0, 1, "study_table"), ("bathroom", "ceiling_light", 0.0, 1, 0.0, 1, ""),
    ("bathroom", "wall_light", 3.0, 1, 6.0, 2, ""), ("hallway", "ceiling_light", 0.0, 1, 8.0, 3, ""),
    ("studio", "ceiling_light", 0.0, 1, 16.0, 3, ""), ("studio", "floor_lamp", 20.0, 1, 0.0, 1, ""),
    ("balcony", "wall_light", 0.0, 1, 6.0, 2, ""), ("utility", "ceiling_light", 0.0, 1, 0.0, 1, ""),
    ("store", "ceiling_light", 0.0, 1, 0.0, 1, ""), ("garage", "ceiling_light", 0.0, 1, 18.0, 3, ""),
    ("staircase", "ceiling_light", 0.0, 1, 0.0, 1, ""),
]
# Room types that stay empty.
UNFURNISHED = ["shaft", "staircase", "unknown"]
# Style, wall, floor and ceiling material, interior kelvin, light gain, softness and roughness bias, trim colour, decor density.
STYLE_PROFILES = [
    ("industrial", "exposed_brick", "polished_concrete", "concrete", 2600.0, 0.85, -0.1, 0.06, "#2F3133", 0.5),
    ("mid_century", "paint_matte", "teak", "gypsum", 2750.0, 0.95, 0.05, 0.0, "#9C6B3F", 0.8),
    ("scandinavian", "paint_matte", "white_oak", "gypsum", 3600.0, 1.15, 0.18, 0.0, "#E0CBA8", 0.45),
    ("minimalist", "paint_matte", "polished_concrete", "gypsum", 3800.0, 1.1, 0.15, 0.0, "#D8D5CF", 0.25),
    ("luxury", "paint_satin", "white_marble", "gypsum", 2700.0, 0.9, 0.08, 0.0, "#B08D45", 0.9),
    ("classic", "paint_satin", "white_marble", "gypsum", 2800.0, 0.95, 0.05, 0.0, "#B08D45", 1.0),
    ("traditional", "wallpaper", "mahogany", "gypsum", 2700.0, 0.9, 0.02, 0.0, "#7A3B2E", 1.0),
    ("japanese", "limewash", "ash", "wood_panel", 3000.0, 0.85, 0.22, 0.0, "#2E2A26", 0.25),
    ("mediterranean", "limewash", "travertine", "limewash", 3200.0, 1.1, 0.16, 0.0, "#C1683F", 0.7),
    ("bohemian", "paint_matte", "teak", "gypsum", 2800.0, 0.9, 0.1, 0.0, "#8C5A3C", 1.0),
    ("farmhouse", "paint_matte", "birch_ply", "wood_panel", 2900.0, 0.95, 0.08, 0.0, "#7A6A55", 0.9),
    ("art_deco", "paint_gloss", "black_marble", "gypsum", 2650.0, 0.85, 0.0, 0.0, "#B08D45", 0.95),
    ("contemporary", "paint_satin", "porcelain_tile", "gypsum", 3300.0, 1.05, 0.1, 0.0, "#4A5259", 0.7),
    ("modern", "paint_matte", "light_oak", "gypsum", 3400.0, 1.05, 0.1, 0.0, "#3C3F44", 0.7),
]
# Style, material family and the species it becomes.
STYLE_SUBSTITUTES = [
    ("industrial", "metal", "blackened_steel"), ("industrial", "concrete", "grey_concrete"),
    ("industrial", "wood", "walnut"), ("industrial", "stone", "slate"),
    ("industrial", "paint_matte", "grey_concrete"), ("mid_century", "wood", "teak"),
    ("mid_century", "fabric", "wool"), ("mid_century", "metal", "brass"), ("scandinavian", "wood", "white_oak"),
    ("scandinavian", "fabric", "wool"), ("scandinavian", "metal", "brushed_steel"),
    ("minimalist", "wood", "white_oak"), ("minimalist", "concrete", "polished_concrete"),
    ("minimalist", "metal", "brushed_steel"), ("luxury", "marble", "white_marble"), ("luxury", "fabric", "velvet"),
    ("luxury", "metal", "brass"), ("luxury", "wood", "walnut"), ("classic", "marble", "white_marble"),
    ("classic", "wood", "walnut"), ("classic", "metal", "brass"), ("traditional", "wood", "mahogany"),
    ("traditional", "fabric", "wool"), ("traditional", "metal", "brass"), ("japanese", "wood", "ash"),
    ("japanese", "fabric", "linen"), ("japanese", "paint_matte", "limewash"),
    ("mediterranean", "stone", "travertine"), ("mediterranean", "paint_matte", "limewash"),
    ("mediterranean", "wood", "teak"), ("mediterranean", "tile", "terrazzo"), ("bohemian", "wood", "teak"),
    ("bohemian", "fabric", "cotton"), ("bohemian", "carpet", "jute"), ("farmhouse", "wood", "birch_ply"),
    ("farmhouse", "fabric", "linen"), ("farmhouse", "metal", "blackened_steel"), ("art_deco", "metal", "brass"),
    ("art_deco", "fabric", "velvet"), ("art_deco", "marble", "black_marble"), ("art_deco", "wood", "ebony"),
    ("contemporary", "wood", "light_oak"), ("contemporary", "tile", "porcelain_tile"),
    ("contemporary", "fabric", "linen"), ("contemporary", "metal", "brushed_steel"),
    ("modern", "wood", "light_oak"), ("modern", "metal", "brushed_steel"), ("modern", "fabric", "linen"),
]

define("dim_furniture_programme", "item_no room_type category min_area item_count per_area max_count importance requires relation relation_target on_surface", [(i, *r) for i, r in enumerate(FURNITURE)])
define("dim_lighting_programme", "room_type kind min_area item_count per_area max_count requires", LIGHTING)
define("dim_style_profiles", "style wall floor ceiling interior_cct light_gain softness_bias roughness_bias trim decor_density", STYLE_PROFILES)
define("dim_style_substitutes", "style family species", STYLE_SUBSTITUTES)
