"""Object, material, style and light catalogs."""

from . import define

# Category, group, typical w/d/h, limits of w, d and h, support, wall affinity and clearance, orientation, asset family, surface and mount height.
OBJECTS = [
    ("sofa", "furniture", 2.1, 0.9, 0.85, 1.4, 3.0, 0.7, 1.1, 0.6, 1.0, "floor", 0.75, 0.05, "face_target", "sofa", 0.42, 1.4),
    ("sectional", "furniture", 2.8, 1.8, 0.85, 2.0, 4.2, 1.2, 2.6, 0.6, 1.0, "floor", 0.8, 0.05, "face_target", "sectional", 0.42, 1.4),
    ("armchair", "furniture", 0.85, 0.85, 0.9, 0.6, 1.2, 0.6, 1.1, 0.6, 1.1, "floor", 0.25, 0.05, "face_target", "armchair", 0.42, 1.4),
    ("chair", "furniture", 0.5, 0.55, 0.9, 0.35, 0.8, 0.35, 0.8, 0.7, 1.1, "floor", 0.0, 0.05, "face_target", "chair", 0.45, 1.4),
    ("dining_chair", "furniture", 0.48, 0.52, 0.92, 0.35, 0.7, 0.35, 0.7, 0.75, 1.1, "floor", 0.0, 0.05, "face_target", "chair", 0.45, 1.4),
    ("office_chair", "furniture", 0.62, 0.62, 1.1, 0.5, 0.8, 0.5, 0.8, 0.85, 1.3, "floor", 0.0, 0.05, "face_target", "office_chair", 0.48, 1.4),
    ("stool", "furniture", 0.38, 0.38, 0.68, 0.28, 0.55, 0.28, 0.55, 0.4, 0.85, "floor", 0.0, 0.05, "free", "stool", 0.68, 1.4),
    ("bench", "furniture", 1.4, 0.4, 0.45, 0.8, 2.2, 0.3, 0.6, 0.35, 0.6, "floor", 0.6, 0.05, "face_room", "box", 0.45, 1.4),
    ("coffee_table", "furniture", 1.2, 0.6, 0.42, 0.7, 1.8, 0.4, 0.9, 0.3, 0.55, "floor", 0.0, 0.05, "face_target", "table", 0.42, 1.4),
    ("dining_table", "furniture", 1.6, 0.9, 0.75, 1.0, 2.8, 0.7, 1.3, 0.68, 0.82, "floor", 0.0, 0.05, "free", "table", 0.75, 1.4),
    ("side_table", "furniture", 0.5, 0.5, 0.55, 0.3, 0.8, 0.3, 0.8, 0.4, 0.75, "floor", 0.3, 0.05, "free", "table", 0.55, 1.4),
    ("bedside_table", "furniture", 0.45, 0.4, 0.55, 0.3, 0.7, 0.3, 0.6, 0.4, 0.75, "floor", 0.85, 0.05, "face_room", "cabinet", 0.55, 1.4),
    ("study_table", "furniture", 1.4, 0.7, 0.75, 0.9, 2.0, 0.5, 0.9, 0.68, 0.82, "floor", 0.75, 0.05, "face_room", "table", 0.75, 1.4),
    ("console_table", "furniture", 1.2, 0.35, 0.8, 0.8, 1.8, 0.25, 0.5, 0.7, 0.95, "floor", 0.95, 0.05, "face_room", "table", 0.8, 1.4),
    ("tv_unit", "furniture", 1.8, 0.45, 0.5, 1.0, 3.0, 0.3, 0.7, 0.3, 0.8, "floor", 0.95, 0.05, "face_room", "tv_unit", 0.5, 1.4),
    ("cabinet", "furniture", 1.0, 0.45, 0.9, 0.5, 2.0, 0.3, 0.7, 0.6, 1.3, "floor", 0.9, 0.05, "face_room", "cabinet", 0.9, 1.4),
    ("wardrobe", "furniture", 1.8, 0.6, 2.2, 0.8, 3.0, 0.5, 0.8, 1.7, 2.6, "floor", 1.0, 0.05, "face_room", "cabinet", 0.0, 1.4),
    ("bookshelf", "furniture", 0.9, 0.35, 1.8, 0.5, 2.0, 0.25, 0.5, 0.8, 2.4, "floor", 1.0, 0.05, "face_room", "bookshelf", 0.0, 1.4),
    ("shelves", "decor", 1.0, 0.28, 0.3, 0.4, 2.0, 0.15, 0.45, 0.03, 1.2, "wall", 0.0, 0.05, "face_room", "shelf", 0.0, 1.5),
    ("sideboard", "furniture", 1.6, 0.45, 0.8, 0.9, 2.4, 0.35, 0.6, 0.6, 1.0, "floor", 0.95, 0.05, "face_room", "cabinet", 0.8, 1.4),
    ("bed", "furniture", 1.6, 2.0, 0.55, 0.9, 2.2, 1.8, 2.2, 0.35, 1.3, "floor", 0.95, 0.05, "face_room", "bed", 0.55, 1.4),
    ("kitchen_island", "furniture", 1.8, 0.9, 0.9, 1.0, 3.0, 0.6, 1.4, 0.85, 1.05, "floor", 0.0, 0.05, "free", "cabinet", 0.9, 1.4),
    ("kitchen_counter", "furniture", 2.4, 0.6, 0.9, 0.8, 5.0, 0.5, 0.8, 0.85, 1.0, "floor", 1.0, 0.05, "face_room", "cabinet", 0.9, 1.4),
    ("toilet", "fixture", 0.38, 0.7, 0.78, 0.3, 0.5, 0.5, 0.9, 0.6, 0.95, "floor", 1.0, 0.05, "face_room", "box", 0.0, 1.4),
    ("sink", "fixture", 0.6, 0.48, 0.85, 0.35, 1.2, 0.3, 0.65, 0.7, 1.0, "floor", 1.0, 0.05, "face_room", "box", 0.85, 1.4),
    ("bathtub", "fixture", 1.7, 0.75, 0.55, 1.2, 2.0, 0.65, 1.0, 0.4, 0.7, "floor", 1.0, 0.05, "face_room", "box", 0.0, 1.4),
    ("shower", "fixture", 0.9, 0.9, 2.0, 0.7, 1.5, 0.7, 1.5, 1.8, 2.3, "floor", 1.0, 0.05, "face_room", "box", 0.0, 1.4),
    ("refrigerator", "appliance", 0.7, 0.7, 1.8, 0.5, 1.2, 0.5, 0.9, 1.2, 2.2, "floor", 1.0, 0.05, "face_room", "cabinet", 0.0, 1.4),
    ("microwave", "appliance", 0.5, 0.4, 0.3, 0.35, 0.7, 0.3, 0.55, 0.22, 0.45, "on_object", 0.0, 0.05, "free", "box", 0.0, 1.4),
    ("washing_machine", "appliance", 0.6, 0.6, 0.85, 0.5, 0.8, 0.5, 0.8, 0.75, 1.0, "floor", 1.0, 0.05, "face_room", "box", 0.0, 1.4),
    ("oven", "appliance", 0.6, 0.58, 0.6, 0.45, 0.8, 0.45, 0.7, 0.45, 1.2, "floor", 1.0, 0.05, "face_room", "box", 0.0, 1.4),
    ("ac_unit", "appliance", 0.9, 0.22, 0.3, 0.6, 1.3, 0.15, 0.35, 0.2, 0.45, "wall", 0.0, 0.05, "face_room", "box", 0.0, 2.3),
    ("tv", "decor", 1.2, 0.07, 0.7, 0.6, 2.2, 0.04, 0.15, 0.35, 1.3, "wall", 0.0, 0.05, "face_room", "screen", 0.0, 1.15),
    ("monitor", "decor", 0.6, 0.2, 0.45, 0.35, 0.9, 0.12, 0.3, 0.3, 0.6, "on_object", 0.0, 0.05, "face_target", "screen", 0.0, 1.4),
    ("laptop", "decor", 0.35, 0.25, 0.22, 0.25, 0.45, 0.18, 0.32, 0.02, 0.3, "on_object", 0.0, 0.05, "free", "box", 0.0, 1.4),
    ("speaker", "decor", 0.25, 0.25, 1.0, 0.12, 0.45, 0.12, 0.45, 0.15, 1.3, "floor", 0.7, 0.05, "free", "box", 0.0, 1.4),
    ("rug", "decor", 2.4, 1.7, 0.02, 0.8, 4.5, 0.6, 3.5, 0.005, 0.06, "floor", 0.0, 0.05, "free", "rug", 0.0, 1.4),
    ("carpet", "decor", 3.0, 2.2, 0.02, 1.0, 6.0, 0.8, 4.5, 0.005, 0.06, "floor", 0.0, 0.05, "free", "rug", 0.0, 1.4),
    ("cushion", "decor", 0.45, 0.45, 0.15, 0.25, 0.7, 0.15, 0.7, 0.08, 0.25, "on_object", 0.0, 0.05, "free", "cushion", 0.0, 1.4),
    ("pillow", "decor", 0.55, 0.35, 0.14, 0.35, 0.8, 0.25, 0.5, 0.08, 0.22, "on_object", 0.0, 0.05, "free", "cushion", 0.0, 1.4),
    ("curtains", "decor", 1.6, 0.12, 2.4, 0.6, 4.0, 0.05, 0.3, 1.0, 3.2, "wall", 0.0, 0.05, "face_room", "curtain", 0.0, 2.55),
    ("blinds", "decor", 1.2, 0.06, 1.4, 0.5, 3.0, 0.03, 0.15, 0.6, 2.6, "wall", 0.0, 0.05, "face_room", "blinds", 0.0, 2.1),
    ("painting", "decor", 0.8, 0.05, 1.0, 0.2, 2.5, 0.02, 0.12, 0.2, 2.0, "wall", 0.0, 0.05, "face_room", "frame", 0.0, 1.55),
    ("mirror", "decor", 0.7, 0.05, 1.2, 0.3, 2.0, 0.02, 0.12, 0.3, 2.2, "wall", 0.0, 0.05, "face_room", "mirror", 0.0, 1.5),
    ("photo_frame", "decor", 0.2, 0.04, 0.25, 0.08, 0.5, 0.02, 0.1, 0.1, 0.5, "on_object", 0.0, 0.05, "face_room", "frame", 0.0, 1.4),
    ("clock", "decor", 0.3, 0.05, 0.3, 0.12, 0.7, 0.03, 0.12, 0.12, 0.7, "wall", 0.0, 0.05, "face_room", "clock", 0.0, 2.0),
    ("plant", "decor", 0.6, 0.6, 1.2, 0.2, 1.4, 0.2, 1.4, 0.2, 2.4, "floor", 0.35, 0.05, "free", "plant", 0.0, 1.4),
    ("flower_vase", "decor", 0.2, 0.2, 0.35, 0.08, 0.45, 0.08, 0.45, 0.1, 0.7, "on_object", 0.0, 0.05, "free", "vase", 0.0, 1.4),
    ("books", "decor", 0.25, 0.16, 0.2, 0.1, 0.5, 0.08, 0.35, 0.03, 0.35, "on_object", 0.0, 0.05, "free", "box", 0.0, 1.4),
    ("bowl", "decor", 0.25, 0.25, 0.1, 0.1, 0.5, 0.1, 0.5, 0.04, 0.25, "on_object", 0.0, 0.05, "free", "vase", 0.0, 1.4),
    ("ceiling_fan", "fixture", 1.2, 1.2, 0.35, 0.7, 1.8, 0.7, 1.8, 0.2, 0.6, "ceiling", 0.0, 0.05, "free", "ceiling_fan", 0.0, 1.4),
]
# Everyday words for categories.
CATEGORY_SYNONYMS = [
    ("wc", "toilet"), ("water closet", "toilet"), ("commode", "toilet"), ("toilet seat", "toilet"),
    ("lavatory", "toilet"), ("closet seat", "toilet"), ("washbasin", "sink"), ("wash basin", "sink"),
    ("basin", "sink"), ("hand basin", "sink"), ("vanity", "sink"), ("vanity unit", "sink"),
    ("wash hand basin", "sink"), ("kitchen sink", "sink"), ("bath", "bathtub"), ("bath tub", "bathtub"),
    ("tub", "bathtub"), ("shower cubicle", "shower"), ("shower tray", "shower"), ("shower enclosure", "shower"),
    ("l-shaped sofa", "sectional"), ("l shaped sofa", "sectional"), ("corner sofa", "sectional"), ("couch", "sofa"),
    ("settee", "sofa"), ("loveseat", "sofa"), ("davenport", "sofa"), ("accent chair", "armchair"),
    ("lounge chair", "armchair"), ("recliner", "armchair"), ("easy chair", "armchair"), ("club chair", "armchair"),
    ("desk chair", "office_chair"), ("swivel chair", "office_chair"), ("task chair", "office_chair"),
    ("bar stool", "stool"), ("counter stool", "stool"), ("ottoman", "stool"), ("pouf", "stool"),
    ("centre table", "coffee_table"), ("center table", "coffee_table"), ("cocktail table", "coffee_table"),
    ("tea table", "coffee_table"), ("dining set", "dining_table"), ("kitchen table", "dining_table"),
    ("end table", "side_table"), ("accent table", "side_table"), ("lamp table", "side_table"),
    ("nightstand", "bedside_table"), ("night stand", "bedside_table"), ("night table", "bedside_table"),
    ("desk", "study_table"), ("writing desk", "study_table"), ("work desk", "study_table"),
    ("computer table", "study_table"), ("workstation", "study_table"), ("tv stand", "tv_unit"),
    ("tv console", "tv_unit"), ("media unit", "tv_unit"), ("media console", "tv_unit"),
    ("entertainment unit", "tv_unit"), ("tv cabinet", "tv_unit"), ("chest of drawers", "cabinet"),
    ("dresser", "cabinet"), ("drawer unit", "cabinet"), ("credenza", "sideboard"), ("buffet", "sideboard"),
    ("closet", "wardrobe"), ("almirah", "wardrobe"), ("armoire", "wardrobe"), ("book shelf", "bookshelf"),
    ("bookcase", "bookshelf"), ("book case", "bookshelf"), ("shelf", "shelves"), ("wall shelf", "shelves"),
    ("floating shelf", "shelves"), ("double bed", "bed"), ("queen bed", "bed"), ("king bed", "bed"),
    ("single bed", "bed"), ("mattress", "bed"), ("platform bed", "bed"), ("island", "kitchen_island"),
    ("breakfast bar", "kitchen_island"), ("countertop", "kitchen_counter"), ("counter", "kitchen_counter"),
    ("kitchen cabinets", "kitchen_counter"), ("fridge", "refrigerator"), ("freezer", "refrigerator"),
    ("washer", "washing_machine"), ("washing machine", "washing_machine"), ("air conditioner", "ac_unit"),
    ("split ac", "ac_unit"), ("ac", "ac_unit"), ("hvac", "ac_unit"), ("television", "tv"), ("flat screen", "tv"),
    ("flatscreen", "tv"), ("tv screen", "tv"), ("computer monitor", "monitor"), ("display", "monitor"),
    ("screen", "monitor"), ("notebook", "laptop"), ("macbook", "laptop"), ("loudspeaker", "speaker"),
    ("sound system", "speaker"), ("soundbar", "speaker"), ("area rug", "rug"), ("floor rug", "rug"),
    ("runner", "rug"), ("throw pillow", "cushion"), ("scatter cushion", "cushion"), ("bolster", "cushion"),
    ("drapes", "curtains"), ("curtain", "curtains"), ("sheers", "curtains"), ("window blinds", "blinds"),
    ("roller blind", "blinds"), ("venetian blinds", "blinds"), ("artwork", "painting"), ("wall art", "painting"),
    ("canvas", "painting"), ("picture", "painting"), ("framed art", "painting"), ("poster", "painting"),
    ("wall mirror", "mirror"), ("looking glass", "mirror"), ("picture frame", "photo_frame"),
    ("photo", "photo_frame"), ("wall clock", "clock"), ("potted plant", "plant"), ("houseplant", "plant"),
    ("indoor plant", "plant"), ("planter", "plant"), ("tree", "plant"), ("greenery", "plant"),
    ("fiddle leaf fig", "plant"), ("vase", "flower_vase"), ("flowers", "flower_vase"),
    ("flower pot", "flower_vase"), ("book", "books"), ("magazines", "books"), ("stack of books", "books"),
    ("fruit bowl", "bowl"), ("decorative bowl", "bowl"), ("fan", "ceiling_fan"),
]
# Size words and their scale.
SIZE_BUCKETS = [
    ("very_small", 0.65), ("small", 0.82), ("medium", 1.0), ("large", 1.22), ("very_large", 1.45),
]
# Material, colour, roughness, metallic, surfaces it applies to, family, texture, grain.
MATERIALS = [
    ("paint_matte", "#EFEDE8", 0.92, 0.0, "wall ceiling", "paint_matte", "flat", 0.02),
    ("paint_satin", "#EFEDE8", 0.55, 0.0, "wall ceiling", "paint_satin", "flat", 0.02),
    ("paint_gloss", "#F2F0EC", 0.22, 0.0, "wall ceiling", "paint_gloss", "flat", 0.01),
    ("wallpaper", "#DED5C8", 0.78, 0.0, "wall", "wallpaper", "weave", 0.18),
    ("wood_panel", "#B08A5E", 0.55, 0.0, "wall ceiling object", "wood_panel", "wood_grain", 0.55),
    ("exposed_brick", "#9B5D45", 0.9, 0.0, "wall", "exposed_brick", "brick", 0.85),
    ("concrete", "#9A9A96", 0.85, 0.0, "wall floor ceiling", "concrete", "noise", 0.45),
    ("marble", "#E8E4DC", 0.18, 0.0, "wall floor object", "marble", "veined", 0.6),
    ("tile", "#DAD8D2", 0.3, 0.0, "wall floor", "tile", "tiled", 0.35),
    ("granite", "#6E6B66", 0.28, 0.0, "floor object", "granite", "speckle", 0.55),
    ("stone", "#A8A29A", 0.8, 0.0, "wall floor", "stone", "noise", 0.7),
    ("wood", "#C08E5C", 0.45, 0.0, "floor object", "wood", "wood_grain", 0.5),
    ("wood_dark", "#6B4A2F", 0.45, 0.0, "floor object", "wood_dark", "wood_grain", 0.5),
    ("wood_light", "#D6B48C", 0.45, 0.0, "floor object", "wood_light", "wood_grain", 0.45),
    ("laminate", "#C6A483", 0.38, 0.0, "floor", "laminate", "wood_grain", 0.25),
    ("vinyl", "#BFB4A6", 0.42, 0.0, "floor", "vinyl", "flat", 0.1),
    ("carpet", "#9A9186", 0.95, 0.0, "floor object", "carpet", "weave", 0.8),
    ("gypsum", "#F6F5F2", 0.9, 0.0, "ceiling", "gypsum", "flat", 0.05),
    ("fabric", "#9C978E", 0.95, 0.0, "object", "fabric", "weave", 0.6),
    ("leather", "#6B4F3A", 0.45, 0.0, "object", "leather", "grain", 0.35),
    ("metal", "#8C8F94", 0.32, 0.9, "object", "metal", "brushed", 0.2),
    ("glass", "#D4E2E6", 0.06, 0.0, "object", "glass", "flat", 0.0),
    ("plastic", "#C9C9C9", 0.5, 0.0, "object", "plastic", "flat", 0.05),
    ("ceramic", "#E4E0D8", 0.25, 0.0, "object", "ceramic", "flat", 0.08),
    ("rattan", "#C4A473", 0.75, 0.0, "object", "rattan", "weave", 0.9),
    ("unknown", "#BFBFBF", 0.65, 0.0, "wall floor ceiling object", "unknown", "flat", 0.0),
]
# Named species of the material families, same columns.
SPECIES = [
    ("light_oak", "#D9BC90", 0.42, 0.0, "floor object", "wood", "wood_grain", 0.45),
    ("white_oak", "#E0CBA8", 0.4, 0.0, "floor object", "wood", "wood_grain", 0.4),
    ("walnut", "#5C4033", 0.44, 0.0, "floor object", "wood", "wood_grain", 0.62),
    ("teak", "#9C6B3F", 0.4, 0.0, "floor object", "wood", "wood_grain", 0.55),
    ("mahogany", "#7A3B2E", 0.38, 0.0, "floor object", "wood", "wood_grain", 0.58),
    ("ash", "#E3D5BC", 0.46, 0.0, "floor object", "wood", "wood_grain", 0.38),
    ("birch_ply", "#E5C79A", 0.5, 0.0, "floor object", "wood", "wood_grain", 0.3),
    ("ebony", "#2E2622", 0.35, 0.0, "floor object", "wood", "wood_grain", 0.5),
    ("white_marble", "#F1EEE8", 0.14, 0.0, "wall floor object", "marble", "veined", 0.6),
    ("black_marble", "#22201F", 0.14, 0.0, "wall floor object", "marble", "veined", 0.6),
    ("green_marble", "#3E5C4B", 0.16, 0.0, "wall floor object", "marble", "veined", 0.6),
    ("travertine", "#D8C7AC", 0.35, 0.0, "wall floor object", "marble", "veined", 0.45),
    ("grey_concrete", "#9A9A96", 0.85, 0.0, "wall floor ceiling", "concrete", "noise", 0.45),
    ("polished_concrete", "#A4A29C", 0.3, 0.0, "wall floor ceiling", "concrete", "noise", 0.25),
    ("terrazzo", "#DCD6C8", 0.35, 0.0, "wall floor ceiling", "concrete", "speckle", 0.75),
    ("slate", "#4A4E51", 0.7, 0.0, "wall floor", "stone", "noise", 0.7),
    ("limestone", "#CFC6B4", 0.75, 0.0, "wall floor", "stone", "noise", 0.7),
    ("porcelain_tile", "#E6E3DC", 0.22, 0.0, "wall floor", "tile", "tiled", 0.35),
    ("ceramic_tile", "#DCD9D1", 0.32, 0.0, "wall floor", "tile", "tiled", 0.35),
    ("mosaic_tile", "#BFD3D6", 0.3, 0.0, "wall floor", "tile", "tiled", 0.6),
    ("subway_tile", "#F0EEE9", 0.2, 0.0, "wall floor", "tile", "tiled", 0.3),
    ("semi_gloss_paint", "#EFEDE8", 0.38, 0.0, "wall ceiling", "paint_satin", "flat", 0.02),
    ("limewash", "#E6DFD2", 0.95, 0.0, "wall ceiling", "paint_matte", "flat", 0.2),
    ("linen", "#D6CDBC", 0.96, 0.0, "object", "fabric", "weave", 0.7),
    ("velvet", "#4A3B52", 0.88, 0.0, "object", "fabric", "weave", 0.35),
    ("boucle", "#E2DBCE", 0.97, 0.0, "object", "fabric", "weave", 0.9),
    ("wool", "#9A9384", 0.95, 0.0, "object", "fabric", "weave", 0.65),
    ("cotton", "#DEDAD2", 0.94, 0.0, "object", "fabric", "weave", 0.5),
    ("jute", "#C2A87C", 0.95, 0.0, "floor object", "carpet", "weave", 0.85),
    ("tan_leather", "#A9764C", 0.46, 0.0, "object", "leather", "grain", 0.35),
    ("black_leather", "#2B2724", 0.42, 0.0, "object", "leather", "grain", 0.35),
    ("brushed_steel", "#9EA2A6", 0.36, 0.9, "object", "metal", "brushed", 0.2),
    ("brass", "#B08D45", 0.3, 0.9, "object", "metal", "brushed", 0.2),
    ("blackened_steel", "#3A3B3D", 0.42, 0.9, "object", "metal", "brushed", 0.2),
    ("chrome", "#C9CDD1", 0.08, 0.9, "object", "metal", "brushed", 0.2),
]
# Everyday words for materials.
MATERIAL_SYNONYMS = [
    ("painted", "paint_matte"), ("paint", "paint_matte"), ("matte paint", "paint_matte"),
    ("emulsion", "paint_matte"), ("plaster", "paint_matte"), ("drywall", "paint_matte"),
    ("satin paint", "paint_satin"), ("eggshell", "paint_satin"), ("gloss paint", "paint_gloss"),
    ("glossy", "paint_gloss"), ("wall paper", "wallpaper"), ("patterned wallpaper", "wallpaper"),
    ("wooden panel", "wood_panel"), ("wood panelling", "wood_panel"), ("wood paneling", "wood_panel"),
    ("timber panel", "wood_panel"), ("slat wall", "wood_panel"), ("veneer", "wood_panel"),
    ("brick", "exposed_brick"), ("brickwork", "exposed_brick"), ("cement", "concrete"), ("screed", "concrete"),
    ("microcement", "concrete"), ("marble tile", "marble"), ("polished marble", "marble"), ("ceramic tile", "tile"),
    ("porcelain", "tile"), ("tiles", "tile"), ("tiled", "tile"), ("hardwood", "wood"), ("wooden", "wood"),
    ("parquet", "wood"), ("timber", "wood"), ("oak", "wood_light"), ("light oak", "wood_light"),
    ("birch", "wood_light"), ("maple", "wood_light"), ("ash", "wood_light"), ("pine", "wood_light"),
    ("walnut", "wood_dark"), ("mahogany", "wood_dark"), ("dark wood", "wood_dark"), ("teak", "wood_dark"),
    ("rug", "carpet"), ("carpeted", "carpet"), ("wool", "carpet"), ("gypsum board", "gypsum"),
    ("false ceiling", "gypsum"), ("pop", "gypsum"), ("plasterboard", "gypsum"), ("pop ceiling", "gypsum"),
    ("upholstery", "fabric"), ("upholstered", "fabric"), ("linen", "fabric"), ("cotton", "fabric"),
    ("velvet", "fabric"), ("textile", "fabric"), ("cloth", "fabric"), ("faux leather", "leather"),
    ("leatherette", "leather"), ("steel", "metal"), ("stainless steel", "metal"), ("chrome", "metal"),
    ("brass", "metal"), ("aluminium", "metal"), ("aluminum", "metal"), ("iron", "metal"),
    ("tempered glass", "glass"), ("mirror", "glass"), ("wicker", "rattan"), ("cane", "rattan"),
    ("bamboo", "rattan"),
]
# Style, its three palette colours, its light bias.
STYLES = [
    ("modern", "#F2F1EE", "#3C3F44", "#9EA2A6", "neutral"), ("minimalist", "#FAF9F6", "#E3DFD7", "#2E2C2A", "cool"),
    ("industrial", "#6E6864", "#9B5D45", "#2F3133", "cool"), ("luxury", "#EFE9DE", "#1F2A33", "#B08D45", "warm"),
    ("scandinavian", "#F4F1EA", "#D9C7A9", "#5A6B72", "neutral"),
    ("contemporary", "#EDEBE6", "#4A5259", "#C0A98B", "neutral"),
    ("traditional", "#E7DFCD", "#6B4A2F", "#7A3B2E", "warm"), ("bohemian", "#D8C3A5", "#8C5A3C", "#3F6B5E", "warm"),
    ("japanese", "#EDE7DA", "#2E2A26", "#7C8A72", "warm"),
    ("mediterranean", "#F0E4D2", "#C1683F", "#4E7B8C", "warm"),
    ("classic", "#F2EDE4", "#2C3A4A", "#B08D45", "warm"), ("farmhouse", "#F5F1E8", "#7A6A55", "#455A4A", "warm"),
    ("art_deco", "#1C1B1A", "#B08D45", "#2E4A52", "warm"), ("mid_century", "#E4D9C4", "#9C6B3F", "#3F5D52", "warm"),
    ("unknown", None, None, None, "neutral"),
]
# Everyday words for styles.
STYLE_SYNONYMS = [
    ("clean", "modern"), ("sleek", "modern"), ("current", "modern"), ("minimal", "minimalist"),
    ("spare", "minimalist"), ("pared back", "minimalist"), ("pared-back", "minimalist"), ("loft", "industrial"),
    ("warehouse", "industrial"), ("utilitarian", "industrial"), ("luxurious", "luxury"), ("opulent", "luxury"),
    ("high end", "luxury"), ("high-end", "luxury"), ("glamorous", "luxury"), ("scandi", "scandinavian"),
    ("nordic", "scandinavian"), ("hygge", "scandinavian"), ("present day", "contemporary"),
    ("present-day", "contemporary"), ("period", "traditional"), ("heritage", "traditional"),
    ("victorian", "traditional"), ("georgian", "traditional"), ("boho", "bohemian"), ("eclectic", "bohemian"),
    ("layered", "bohemian"), ("japandi", "japanese"), ("zen", "japanese"), ("wabi sabi", "japanese"),
    ("wabi-sabi", "japanese"), ("coastal", "mediterranean"), ("spanish", "mediterranean"),
    ("greek", "mediterranean"), ("santorini", "mediterranean"), ("neoclassical", "classic"),
    ("timeless", "classic"), ("formal", "classic"), ("rustic", "farmhouse"), ("country", "farmhouse"),
    ("shaker", "farmhouse"), ("cottage", "farmhouse"), ("deco", "art_deco"), ("gatsby", "art_deco"),
    ("jazz age", "art_deco"), ("mid century", "mid_century"), ("mid-century", "mid_century"),
    ("midcentury", "mid_century"), ("retro", "mid_century"), ("50s", "mid_century"), ("60s", "mid_century"),
]
# Materials a style is expected to show.
STYLE_MATERIALS = [
    ("modern", "paint_matte"), ("modern", "light_oak"), ("modern", "brushed_steel"), ("modern", "glass"),
    ("minimalist", "paint_matte"), ("minimalist", "white_oak"), ("minimalist", "polished_concrete"),
    ("industrial", "exposed_brick"), ("industrial", "grey_concrete"), ("industrial", "blackened_steel"),
    ("industrial", "reclaimed"), ("luxury", "white_marble"), ("luxury", "velvet"), ("luxury", "brass"),
    ("luxury", "walnut"), ("scandinavian", "white_oak"), ("scandinavian", "ash"), ("scandinavian", "wool"),
    ("scandinavian", "paint_matte"), ("contemporary", "paint_satin"), ("contemporary", "light_oak"),
    ("contemporary", "porcelain_tile"), ("contemporary", "linen"), ("traditional", "mahogany"),
    ("traditional", "wallpaper"), ("traditional", "wool"), ("traditional", "tan_leather"), ("bohemian", "rattan"),
    ("bohemian", "jute"), ("bohemian", "cotton"), ("bohemian", "teak"), ("japanese", "ash"), ("japanese", "paper"),
    ("japanese", "birch_ply"), ("japanese", "limewash"), ("mediterranean", "limewash"),
    ("mediterranean", "terracotta"), ("mediterranean", "travertine"), ("mediterranean", "rattan"),
    ("classic", "white_marble"), ("classic", "paint_satin"), ("classic", "walnut"), ("classic", "brass"),
    ("farmhouse", "paint_matte"), ("farmhouse", "reclaimed"), ("farmhouse", "birch_ply"), ("farmhouse", "linen"),
    ("art_deco", "brass"), ("art_deco", "velvet"), ("art_deco", "black_marble"), ("art_deco", "ebony"),
    ("mid_century", "teak"), ("mid_century", "wool"), ("mid_century", "brass"), ("mid_century", "walnut"),
]
# Light kind, mounting, power, size, colour temperature, default height.
LIGHTS = [
    ("recessed_light", "ceiling", 18.0, 0.09, 3200.0, 2.95), ("ceiling_light", "ceiling", 45.0, 0.35, 3200.0, 2.9),
    ("chandelier", "ceiling", 90.0, 0.45, 2700.0, 2.35), ("pendant_light", "ceiling", 30.0, 0.22, 2700.0, 1.9),
    ("led_strip", "ceiling", 22.0, 0.05, 3000.0, 2.85), ("cove_light", "ceiling", 26.0, 0.08, 2900.0, 2.8),
    ("wall_light", "wall", 20.0, 0.14, 2700.0, 1.95), ("floor_lamp", "floor", 35.0, 0.28, 2700.0, 1.55),
    ("table_lamp", "table", 18.0, 0.2, 2700.0, 0.45), ("spotlight", "ceiling", 24.0, 0.08, 3400.0, 2.9),
]
# Everyday words for lights.
LIGHT_SYNONYMS = [
    ("downlight", "recessed_light"), ("down light", "recessed_light"), ("can light", "recessed_light"),
    ("recessed spotlight", "recessed_light"), ("pot light", "recessed_light"), ("ceiling lamp", "ceiling_light"),
    ("flush mount", "ceiling_light"), ("ceiling fixture", "ceiling_light"), ("surface light", "ceiling_light"),
    ("hanging light", "pendant_light"), ("pendant", "pendant_light"), ("drop light", "pendant_light"),
    ("hanging lamp", "pendant_light"), ("led strip", "led_strip"), ("strip light", "led_strip"),
    ("linear light", "led_strip"), ("light strip", "led_strip"), ("under cabinet light", "led_strip"),
    ("cove lighting", "cove_light"), ("indirect lighting", "cove_light"), ("sconce", "wall_light"),
    ("wall sconce", "wall_light"), ("wall lamp", "wall_light"), ("picture light", "wall_light"),
    ("standing lamp", "floor_lamp"), ("tall lamp", "floor_lamp"), ("arc lamp", "floor_lamp"),
    ("desk lamp", "table_lamp"), ("bedside lamp", "table_lamp"), ("side lamp", "table_lamp"),
    ("track light", "spotlight"), ("accent light", "spotlight"),
]
# Subject category, predicate, object category.
IMPLIED_RELATIONS = [
    ("sofa", "faces", "tv_unit"), ("sofa", "faces", "tv"), ("sectional", "faces", "tv_unit"),
    ("sectional", "faces", "tv"), ("armchair", "faces", "coffee_table"),
    ("dining_chair", "surrounds", "dining_table"), ("chair", "surrounds", "dining_table"),
    ("bedside_table", "beside", "bed"), ("table_lamp", "on_top_of", "bedside_table"),
    ("office_chair", "faces", "study_table"), ("rug", "centered_under", "coffee_table"),
    ("carpet", "centered_under", "coffee_table"), ("coffee_table", "faces", "sofa"), ("tv", "mounted_on", "wall"),
    ("cushion", "on_top_of", "sofa"), ("pillow", "on_top_of", "bed"), ("monitor", "on_top_of", "study_table"),
    ("laptop", "on_top_of", "study_table"), ("flower_vase", "on_top_of", "coffee_table"),
    ("books", "on_top_of", "coffee_table"), ("microwave", "on_top_of", "kitchen_counter"),
]
# Categories that mark a room type.
ROOM_MARKERS = {
    "living_room": ["sofa", "sectional", "coffee_table", "tv_unit", "tv", "armchair"],
    "bedroom": ["bed", "bedside_table", "wardrobe"],
    "kitchen": ["kitchen_counter", "kitchen_island", "refrigerator", "microwave", "oven"],
    "dining_room": ["dining_table", "dining_chair"],
    "office": ["study_table", "office_chair", "monitor", "bookshelf"],
}

define("dim_objects", "category obj_group typical_w typical_d typical_h w_lo w_hi d_lo d_hi h_lo h_hi support wall_affinity wall_clearance orientation asset_family surface_height mount_height", OBJECTS)
define("dim_category_synonyms", "term category", CATEGORY_SYNONYMS)
define("dim_size_buckets", "bucket factor", SIZE_BUCKETS)
define("dim_materials", "material color_hex roughness metallic applies_to family texture grain", MATERIALS + SPECIES)
define("dim_material_synonyms", "term material", MATERIAL_SYNONYMS)
define("dim_styles", "style color_1 color_2 color_3 lighting", STYLES)
define("dim_style_synonyms", "term style", STYLE_SYNONYMS)
define("dim_style_materials", "style material", STYLE_MATERIALS)
define("dim_lights", "kind mounting power_w size_m kelvin default_height", LIGHTS)
define("dim_light_synonyms", "term kind", LIGHT_SYNONYMS)
define("dim_implied_relations", "rule_no subject_category predicate object_category", [(i, *r) for i, r in enumerate(IMPLIED_RELATIONS)])
define("dim_room_markers", "room_type category", [(room, c) for room, cs in ROOM_MARKERS.items() for c in cs])
