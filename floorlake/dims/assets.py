"""Asset variants an object can be built from."""

from . import define

# Asset key, category, builder, proportions w/d/h, styles and materials it suits, tone.
VARIANTS = [
    ("sofa_low_modern", "sofa", "build_sofa", 2.47, 1.06, 1.0, "modern minimal scandinavian contemporary", "fabric", "any"),
    ("sofa_deep_lounge", "sofa", "build_sofa", 2.2, 1.2, 1.0, "contemporary luxury modern", "fabric leather", "any"),
    ("sofa_classic_arms", "sofa", "build_sofa", 2.35, 1.0, 1.0, "traditional classic vintage", "fabric leather", "any"),
    ("sectional_l_wide", "sectional", "build_sectional", 3.29, 2.12, 1.0, "modern contemporary minimal", "fabric", "any"),
    ("sectional_compact", "sectional", "build_sectional", 2.7, 1.65, 1.0, "scandinavian minimal modern", "fabric", "any"),
    ("armchair_tub", "armchair", "build_armchair", 0.94, 0.94, 1.0, "modern contemporary", "fabric leather", "any"),
    ("armchair_wing", "armchair", "build_armchair", 0.85, 0.9, 1.0, "traditional classic", "fabric", "any"),
    ("chair_dining_wood", "dining_chair", "build_chair", 0.52, 0.57, 1.0, "scandinavian modern minimal", "wood wood_light", "any"),
    ("chair_upholstered", "dining_chair", "build_chair", 0.55, 0.6, 1.0, "contemporary luxury traditional", "fabric leather", "any"),
    ("chair_generic", "chair", "build_chair", 0.55, 0.61, 1.0, "", "", "any"),
    ("office_chair_task", "office_chair", "build_office_chair", 0.56, 0.56, 1.0, "", "", "any"),
    ("stool_round", "stool", "build_stool", 0.56, 0.56, 1.0, "", "", "any"),
    ("bench_plain", "bench", "build_box_furniture", 3.11, 0.89, 1.0, "", "", "any"),
    ("table_rect_tapered", "coffee_table", "build_table", 2.86, 1.43, 1.0, "scandinavian modern minimal", "wood wood_light", "any"),
    ("table_round_pedestal", "coffee_table", "build_table", 2.2, 2.2, 1.0, "contemporary modern", "marble glass wood", "any"),
    ("table_low_slab", "coffee_table", "build_table", 3.1, 1.55, 1.0, "industrial modern", "concrete wood_dark marble", "any"),
    ("dining_rect_legs", "dining_table", "build_table", 2.13, 1.2, 1.0, "modern scandinavian minimal", "wood wood_light", "any"),
    ("dining_round", "dining_table", "build_table", 1.6, 1.6, 1.0, "contemporary traditional", "wood marble", "any"),
    ("side_table_simple", "side_table", "build_table", 0.91, 0.91, 1.0, "", "", "any"),
    ("console_slim", "console_table", "build_table", 1.5, 0.44, 1.0, "", "", "any"),
    ("desk_rect", "study_table", "build_table", 1.87, 0.93, 1.0, "modern minimal", "wood wood_light laminate", "any"),
    ("tv_unit_low_wide", "tv_unit", "build_tv_unit", 3.6, 0.9, 1.0, "modern minimal scandinavian", "wood wood_light", "any"),
    ("tv_unit_cabinet", "tv_unit", "build_tv_unit", 3.0, 0.85, 1.0, "contemporary traditional", "wood_dark wood", "any"),
    ("cabinet_doors", "cabinet", "build_cabinet", 1.11, 0.5, 1.0, "", "", "any"),
    ("sideboard_long", "sideboard", "build_cabinet", 2.0, 0.56, 1.0, "", "", "any"),
    ("bedside_simple", "bedside_table", "build_cabinet", 0.82, 0.73, 1.0, "", "", "any"),
    ("wardrobe_tall", "wardrobe", "build_cabinet", 0.82, 0.27, 1.0, "", "", "any"),
    ("bookshelf_open", "bookshelf", "build_bookshelf", 0.5, 0.19, 1.0, "", "", "any"),
    ("shelf_floating", "shelves", "build_shelf", 3.33, 0.93, 1.0, "", "", "any"),
    ("kitchen_island_block", "kitchen_island", "build_cabinet", 2.0, 1.0, 1.0, "", "", "any"),
    ("kitchen_counter_run", "kitchen_counter", "build_cabinet", 2.67, 0.67, 1.0, "", "", "any"),
    ("bed_platform_low", "bed", "build_bed", 2.91, 3.64, 1.0, "modern minimal scandinavian", "", "any"),
    ("bed_upholstered", "bed", "build_bed", 2.7, 3.4, 1.0, "contemporary luxury", "fabric", "any"),
    ("fridge_tall", "refrigerator", "build_box_furniture", 0.39, 0.39, 1.0, "", "metal", "any"),
    ("microwave_box", "microwave", "build_box_furniture", 1.67, 1.33, 1.0, "", "metal", "any"),
    ("washer_box", "washing_machine", "build_box_furniture", 0.71, 0.71, 1.0, "", "metal", "any"),
    ("oven_box", "oven", "build_box_furniture", 1.0, 0.97, 1.0, "", "metal", "any"),
    ("ac_wall_split", "ac_unit", "build_box_furniture", 3.0, 0.73, 1.0, "", "plastic", "any"),
    ("tv_panel", "tv", "build_screen", 1.71, 0.1, 1.0, "", "", "any"),
    ("monitor_panel", "monitor", "build_screen", 1.33, 0.44, 1.0, "", "", "any"),
    ("laptop_open", "laptop", "build_box_furniture", 1.59, 1.14, 1.0, "", "", "any"),
    ("speaker_tower", "speaker", "build_box_furniture", 0.25, 0.25, 1.0, "", "", "any"),
    ("rug_rect", "rug", "build_rug", 120.0, 85.0, 1.0, "", "", "any"),
    ("carpet_rect", "carpet", "build_rug", 150.0, 110.0, 1.0, "", "", "any"),
    ("cushion_square", "cushion", "build_cushion", 3.0, 3.0, 1.0, "", "", "any"),
    ("pillow_long", "pillow", "build_cushion", 3.93, 2.5, 1.0, "", "", "any"),
    ("curtain_pair", "curtains", "build_curtain", 0.67, 0.05, 1.0, "", "", "any"),
    ("blinds_flat", "blinds", "build_blinds", 0.86, 0.04, 1.0, "", "", "any"),
    ("painting_frame", "painting", "build_frame", 0.8, 0.05, 1.0, "", "", "any"),
    ("mirror_frame", "mirror", "build_frame", 0.58, 0.04, 1.0, "", "glass", "any"),
    ("photo_frame_small", "photo_frame", "build_frame", 0.8, 0.16, 1.0, "", "", "any"),
    ("clock_round", "clock", "build_clock", 1.0, 0.17, 1.0, "", "", "any"),
    ("plant_tall", "plant", "build_plant", 0.5, 0.5, 1.0, "", "", "any"),
    ("vase_round", "flower_vase", "build_vase", 0.57, 0.57, 1.0, "", "ceramic glass", "any"),
    ("books_stack", "books", "build_box_furniture", 1.25, 0.8, 1.0, "", "", "any"),
    ("bowl_round", "bowl", "build_vase", 2.5, 2.5, 1.0, "", "ceramic", "any"),
    ("ceiling_fan_blades", "ceiling_fan", "build_ceiling_fan", 3.43, 3.43, 1.0, "", "", "any"),
]

define("dim_assets", "asset_no asset category builder sig_w sig_d sig_h styles materials tone", [(i, *v) for i, v in enumerate(VARIANTS)])
