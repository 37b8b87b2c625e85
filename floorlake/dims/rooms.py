"""Room-type priors and the evidence tables of room classification."""

from . import define

# Room type, area low, high and typical, largest aspect, usual doors and windows, windowless share, privacy, may repeat.
ROOM_PRIORS = [
    ("living_room", 12.0, 70.0, 24.0, 2.2, 2, 2, 0.05, 0.2, False),
    ("bedroom", 7.5, 32.0, 13.0, 2.0, 1, 1, 0.05, 0.9, True),
    ("kitchen", 4.0, 25.0, 10.0, 3.0, 1, 1, 0.3, 0.4, False),
    ("dining_room", 7.0, 35.0, 15.0, 2.2, 2, 1, 0.15, 0.3, False),
    ("bathroom", 1.8, 12.0, 4.5, 2.6, 1, 0, 0.75, 0.95, True),
    ("office", 5.0, 25.0, 11.0, 2.2, 1, 1, 0.1, 0.7, True), ("hallway", 1.5, 30.0, 7.0, 8.0, 4, 0, 0.75, 0.3, True),
    ("balcony", 1.5, 25.0, 6.0, 5.0, 1, 0, 0.2, 0.5, True), ("utility", 1.5, 14.0, 5.0, 3.0, 1, 0, 0.8, 0.7, True),
    ("store", 0.8, 12.0, 3.5, 3.5, 1, 0, 0.9, 0.8, True), ("garage", 12.0, 60.0, 20.0, 2.5, 2, 0, 0.7, 0.2, True),
    ("staircase", 2.0, 20.0, 7.0, 3.5, 2, 0, 0.55, 0.3, True), ("shaft", 0.3, 6.0, 1.2, 4.0, 0, 0, 0.95, 0.5, True),
    ("studio", 15.0, 60.0, 30.0, 2.5, 1, 2, 0.05, 0.5, False),
]
# How much a neighbour speaks for a room type.
ROOM_ADJACENCY = {
    "living_room": {"dining_room": 1.0, "hallway": 0.8, "kitchen": 0.6, "balcony": 0.5},
    "bedroom": {"bathroom": 1.0, "hallway": 0.8, "balcony": 0.4},
    "kitchen": {"dining_room": 1.0, "utility": 0.8, "living_room": 0.6, "balcony": 0.4},
    "dining_room": {"kitchen": 1.0, "living_room": 1.0},
    "bathroom": {"bedroom": 1.0, "hallway": 0.7},
    "office": {"hallway": 0.7, "living_room": 0.4},
    "hallway": {"bedroom": 1.0, "bathroom": 0.8, "living_room": 0.8},
    "balcony": {"living_room": 0.8, "bedroom": 0.6, "kitchen": 0.4},
    "utility": {"kitchen": 1.0, "hallway": 0.5},
    "store": {"hallway": 0.8, "bedroom": 0.5, "kitchen": 0.4},
    "garage": {"hallway": 0.6, "utility": 0.5},
    "staircase": {"hallway": 1.0},
    "studio": {"hallway": 0.6, "balcony": 0.4},
}
# What an object says about its room.
OBJECT_EVIDENCE = {
    "toilet": {"bathroom": 4.2, "utility": -1.0, "store": -2.5, "kitchen": -3.0, "bedroom": -3.0, "living_room": -3.5, "dining_room": -3.5},
    "urinal": {"bathroom": 4.0, "store": -2.5, "kitchen": -3.0, "bedroom": -3.0},
    "bidet": {"bathroom": 3.8, "store": -2.0, "kitchen": -2.5},
    "bathtub": {"bathroom": 4.0, "store": -2.0, "kitchen": -3.0, "bedroom": -2.0},
    "shower": {"bathroom": 3.8, "utility": 0.3, "store": -1.8, "kitchen": -2.5},
    "washbasin": {"bathroom": 2.6, "utility": 0.8, "kitchen": 0.4, "living_room": -1.0, "bedroom": -0.8},
    "floor_drain": {"bathroom": 1.6, "utility": 1.2, "balcony": 0.6, "living_room": -1.2, "bedroom": -1.5},
    "water_heater": {"bathroom": 1.6, "utility": 1.8, "kitchen": 0.8, "living_room": -1.5, "bedroom": -1.5},
    "sink": {"kitchen": 3.2, "utility": 1.4, "bathroom": 0.4, "bedroom": -2.0, "living_room": -2.0},
    "cooktop": {"kitchen": 4.2, "utility": 0.4, "bedroom": -3.5, "bathroom": -3.5, "living_room": -3.0},
    "oven": {"kitchen": 3.4, "utility": 0.4, "bedroom": -2.5, "bathroom": -2.5},
    "range_hood": {"kitchen": 3.6, "utility": 0.3, "bedroom": -2.5},
    "refrigerator": {"kitchen": 3.2, "utility": 0.8, "dining_room": 0.4, "bathroom": -2.5, "bedroom": -1.5},
    "dishwasher": {"kitchen": 3.0, "utility": 1.0, "bedroom": -2.0},
    "kitchen_counter": {"kitchen": 3.0, "utility": 0.8, "bathroom": -0.5, "bedroom": -1.5},
    "kitchen_island": {"kitchen": 3.4, "dining_room": 0.5, "bedroom": -2.0},
    "washing_machine": {"utility": 3.0, "bathroom": 1.4, "kitchen": 1.0, "living_room": -1.5, "bedroom": -1.5},
    "bed": {"bedroom": 4.2, "studio": 1.2, "living_room": -2.0, "kitchen": -3.5, "bathroom": -3.5, "hallway": -2.5},
    "bedside_table": {"bedroom": 3.0, "studio": 0.8, "kitchen": -2.0, "bathroom": -2.0},
    "wardrobe": {"bedroom": 2.2, "store": 1.2, "bathroom": -0.5, "kitchen": -1.5},
    "dressing_table": {"bedroom": 2.0, "bathroom": 0.6, "kitchen": -1.5},
    "sofa": {"living_room": 3.0, "studio": 1.0, "office": 0.4, "bathroom": -3.0, "kitchen": -2.0, "bedroom": -0.5},
    "sectional": {"living_room": 3.2, "studio": 1.0, "bathroom": -3.0, "kitchen": -2.0},
    "armchair": {"living_room": 1.8, "office": 0.6, "bedroom": 0.4, "bathroom": -2.0},
    "coffee_table": {"living_room": 2.6, "studio": 0.8, "bathroom": -2.5, "kitchen": -1.5},
    "tv_unit": {"living_room": 2.4, "bedroom": 0.6, "bathroom": -2.5},
    "tv": {"living_room": 1.6, "bedroom": 0.8, "kitchen": -0.5, "bathroom": -2.0},
    "dining_table": {"dining_room": 3.0, "kitchen": 1.0, "living_room": 0.8, "bathroom": -3.0, "bedroom": -1.5},
    "dining_chair": {"dining_room": 2.0, "kitchen": 0.8, "living_room": 0.4, "bathroom": -2.5, "bedroom": -1.0},
    "sideboard": {"dining_room": 1.6, "living_room": 0.8, "kitchen": 0.6},
    "study_table": {"office": 2.8, "bedroom": 0.8, "living_room": 0.3, "bathroom": -2.5, "kitchen": -1.5},
    "office_chair": {"office": 2.4, "bedroom": 0.6, "bathroom": -2.5},
    "bookshelf": {"office": 1.8, "living_room": 0.8, "bedroom": 0.6, "bathroom": -1.5},
    "chair": {"dining_room": 0.5, "office": 0.4, "living_room": 0.3, "bathroom": -1.0},
    "table": {"dining_room": 0.6, "living_room": 0.4, "office": 0.3, "bathroom": -1.0},
    "stool": {"kitchen": 0.5, "dining_room": 0.4, "bathroom": 0.2},
    "cabinet": {"store": 0.6, "kitchen": 0.5, "utility": 0.4},
    "plant": {"living_room": 0.4, "balcony": 0.8, "bathroom": -0.3},
    "rug": {"living_room": 0.8, "bedroom": 0.6, "bathroom": -0.8, "kitchen": -0.8},
    "car": {"garage": 4.5, "living_room": -4.0, "bedroom": -4.0, "bathroom": -4.0, "kitchen": -4.0},
    "piano": {"living_room": 2.0, "studio": 1.0, "bathroom": -3.0},
}
# What entities on a layer role say about their room.
LAYER_EVIDENCE = {
    "plumbing_fixture": {"bathroom": 1.8, "kitchen": 0.8, "utility": 0.6, "living_room": -1.0, "bedroom": -1.0},
    "casework": {"kitchen": 0.8, "store": 0.6, "bedroom": 0.4},
    "appliance": {"kitchen": 1.2, "utility": 0.8, "bathroom": -0.5},
    "furniture": {"living_room": 0.4, "bedroom": 0.4, "dining_room": 0.3},
    "stair": {"staircase": 2.5, "hallway": 0.8},
    "plumbing": {"bathroom": 1.0, "kitchen": 0.8, "utility": 0.6},
}
# Categories that decide on their own.
DECISIVE = [
    ("toilet",), ("urinal",), ("bidet",), ("bathtub",), ("shower",), ("cooktop",), ("sink",), ("range_hood",),
    ("refrigerator",), ("bed",), ("sofa",), ("sectional",), ("dining_table",), ("car",),
]
# Detected category and the category whose evidence it carries.
VISION_ALIASES = [
    ("kitchen_counter", "kitchen_counter"), ("microwave", "oven"), ("carpet", "rug"),
    ("console_table", "dressing_table"), ("side_table", "bedside_table"), ("shelves", "bookshelf"),
    ("monitor", "study_table"), ("laptop", "study_table"),
]
# Plausible area per room type when matching pictures to regions.
AREA_PRIORS = [
    ("living_room", 14.0, 60.0), ("bedroom", 9.0, 30.0), ("kitchen", 5.0, 18.0), ("dining_room", 8.0, 25.0),
    ("bathroom", 2.5, 8.0), ("office", 6.0, 16.0), ("hallway", 2.0, 12.0), ("balcony", 2.0, 12.0),
]

define("dim_room_priors", "room_type area_lo area_hi area_typical aspect_max doors_typical windows_typical windowless privacy repeatable", ROOM_PRIORS)
define("dim_room_adjacency", "room_type neighbour_type weight", [(a, b, w) for a, row in ROOM_ADJACENCY.items() for b, w in row.items()])
define("dim_object_evidence", "category room_type score", [(c, r, s) for c, row in OBJECT_EVIDENCE.items() for r, s in row.items()])
define("dim_layer_evidence", "role room_type score", [(c, r, s) for c, row in LAYER_EVIDENCE.items() for r, s in row.items()])
define("dim_decisive", "category", DECISIVE)
define("dim_vision_aliases", "raw_category category", VISION_ALIASES)
define("dim_area_priors", "room_type area_lo area_hi", AREA_PRIORS)
