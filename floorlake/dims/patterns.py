"""Naming conventions: ordered patterns for room labels, layers and blocks, and drawing units."""

from . import define

# Room type and the label patterns that name it, first match wins.
ROOM_LABELS = [
    ("bathroom", [r"\bBATH ?ROOMS?\b", r"\bBATHS?\b", r"\bW\.? ?C\.?\b", r"\bWATER CLOSET\b", r"\bTOILETS?\b", r"\bREST ?ROOMS?\b", r"\bLAVATORY\b", r"\bPOWDER ?(ROOM|RM)\b", r"\bENSUITE\b", r"\bEN ?SUITE\b", r"\bSHOWER ?(ROOM|RM)\b", r"\bWASH ?ROOMS?\b", r"\bSANITARY\b", r"\bLOO\b", r"\bCLOAK ?(ROOM|RM)\b", r"\bATT ?BATH\b", r"\bCOMMON ?BATH\b", r"\bBATH ?ATT\b"]),
    ("kitchen", [r"\bKITCHENS?\b", r"\bKIT\.?\b", r"\bKITCH\b", r"\bGALLEY\b", r"\bPANTRY\b", r"\bSCULLERY\b", r"\bKITCHENETTE\b", r"\bCOOK(ING)? ?(AREA|RM)\b"]),
    ("dining_room", [r"\bDINING ?(ROOM|RM|AREA|HALL|SPACE)?\b", r"\bDIN\.? ?(RM|ROOM)\b", r"\bBREAKFAST\b", r"\bMESS\b", r"\bDINETTE\b"]),
    ("master_bedroom", [r"\bMASTER ?BED ?(ROOM|RM)?\b", r"\bM\.? ?BED ?(ROOM|RM)?\b", r"\bMASTER ?SUITE\b", r"\bPRIMARY ?BED ?(ROOM|RM)?\b", r"\bMBR\b"]),
    ("bedroom", [r"\bBED ?ROOMS?\b", r"\bBED ?RMS?\b", r"\bBEDS?\b(?! ?SIDE)", r"\bBR ?[0-9]\b", r"\bGUEST ?(ROOM|RM|BED)\b", r"\bKIDS? ?(ROOM|RM|BED)\b", r"\bCHILD(REN)?S? ?(ROOM|RM)\b", r"\bNURSERY\b", r"\bDORM\b"]),
    ("living_room", [r"\bLIVING ?(ROOM|RM|AREA|SPACE|HALL)?\b", r"\bLIV\.? ?(RM|ROOM)?\b", r"\bDRAWING ?(ROOM|RM)\b", r"\bLOUNGE\b", r"\bSITTING ?(ROOM|RM|AREA)\b", r"\bFAMILY ?(ROOM|RM)\b", r"\bGREAT ?(ROOM|RM)\b", r"\bPARLOU?R\b", r"\bDEN\b", r"\bSALON\b", r"\bRECEPTION\b"]),
    ("office", [r"\bOFFICES?\b", r"\bSTUDY\b", r"\bWORK ?(ROOM|RM|SPACE|STATION)\b", r"\bLIBRARY\b", r"\bCABIN\b", r"\bHOME ?OFFICE\b"]),
    ("studio", [r"\bSTUDIO\b", r"\bATELIER\b"]),
    ("hallway", [r"\bHALL ?WAYS?\b", r"\bCORRIDORS?\b", r"\bPASSAGES?\b", r"\bFOYER\b", r"\bLOBBY\b", r"\bVESTIBULE\b", r"\bENTRY\b", r"\bENTRANCE\b", r"\bLANDING\b", r"\bCIRCULATION\b", r"\bHALLS?\b", r"\bPORCH\b"]),
    ("staircase", [r"\bSTAIR ?(CASE|WELL|S)?\b", r"\bSTEPS\b", r"\bLIFT\b", r"\bELEVATOR\b"]),
    ("utility", [r"\bUTILITY\b", r"\bLAUNDRY\b", r"\bWASH ?(ROOM|AREA)\b", r"\bMACHINE ?(RM|ROOM)\b", r"\bSERVICE ?(ROOM|RM|AREA)\b", r"\bBOILER ?(ROOM|RM)\b", r"\bPLANT ?(ROOM|RM)\b", r"\bELECT(RICAL)? ?(ROOM|RM)\b", r"\bMECH(ANICAL)? ?(ROOM|RM)\b"]),
    ("store", [r"\bSTORES?\b", r"\bSTORAGE\b", r"\bSTORE ?(ROOM|RM)\b", r"\bCLOSET\b", r"\bWARDROBE ?(ROOM|RM)\b", r"\bWALK ?IN\b", r"\bLARDER\b", r"\bATTIC\b", r"\bLOFT\b", r"\bBASEMENT\b", r"\bCELLAR\b"]),
    ("garage", [r"\bGARAGE\b", r"\bCAR ?(PARK|PORT)\b", r"\bPARKING\b", r"\bSTILT\b"]),
    ("balcony", [r"\bBALCONY\b", r"\bBALC\.?\b", r"\bTERRACE\b", r"\bDECK\b", r"\bVERANDAH?\b", r"\bPATIO\b", r"\bLOGGIA\b", r"\bSIT ?OUT\b", r"\bOPEN ?TO ?SKY\b", r"\bOTS\b", r"\bCOURT ?YARD\b", r"\bGARDEN\b", r"\bLAWN\b"]),
    ("shaft", [r"\bSHAFTS?\b", r"\bDUCT\b", r"\bVOID\b", r"\bCHASE\b", r"\bRISER\b", r"\bAIR ?SHAFT\b"]),
]
# Whole labels that are drawing metadata.
TITLE_NOISE = (
    r"^(?:"
    r"(?:GROUND|FIRST|SECOND|THIRD|TYPICAL|UPPER|LOWER|BASEMENT|ROOF|[0-9]+(?:ST|ND|RD|TH))?\s*FLOOR\s*PLAN"
    r"|(?:SITE|LAYOUT|KEY|LOCATION|ROOF|CEILING|FURNITURE|ELECTRICAL|PLUMBING)\s*PLAN"
    r"|SCALE\s*[:=]?.*"
    r"|N\.?T\.?S\.?"
    r"|DO\s*NOT\s*SCALE.*"
    r"|DRAWN\s*BY.*"
    r"|CHECKED\s*BY.*"
    r"|APPROVED.*"
    r"|CLIENT.*"
    r"|PROJECT.*"
    r"|DRAWING\s*(NO|TITLE).*"
    r"|SHEET\s*(NO)?.*"
    r"|REV(ISION)?\s*(NO)?.*"
    r"|DATE\s*[:=]?.*"
    r"|ALL\s+DIMENSIONS?.*"
    r"|NOTES?\s*[:=]?"
    r"|LEGEND"
    r"|GENERAL\s+NOTES?"
    r"|SECTION\s*[-A-Z0-9 ]*"
    r"|ELEVATION\s*[-A-Z0-9 ]*"
    r"|DETAIL\s*[-A-Z0-9 ]*"
    r"|NORTH"
    r"|TRUE\s*NORTH"
    r")$"
)
# Specific room type and its parent.
ROOM_PARENTS = [
    ("master_bedroom", "bedroom"), ("staircase", "hallway"), ("studio", "living_room"),
]
# Known discipline letters.
AIA_DISCIPLINES = [
    ("A",), ("I",), ("S",), ("M",), ("E",), ("P",), ("F",), ("C",), ("L",), ("Q",), ("G",), ("T",), ("X",),
]
# Major group and role.
AIA_MAJOR = [
    ("WALL", "wall"), ("DOOR", "door"), ("GLAZ", "window"), ("COLS", "column"), ("BEAM", "beam"), ("STRS", "stair"),
    ("HRAL", "railing"), ("FLOR", "floor"), ("CLNG", "ceiling"), ("ROOF", "roof"), ("FURN", "furniture"),
    ("CASE", "casework"), ("EQPM", "equipment"), ("APPL", "appliance"), ("PFIX", "plumbing_fixture"),
    ("TPTN", "casework"), ("AREA", "area"), ("ANNO", "annotation"), ("IDEN", "text"), ("DIMS", "dimension"),
    ("PATT", "hatch"), ("GRID", "grid"), ("LITE", "electrical"), ("POWR", "electrical"), ("HVAC", "hvac"),
    ("PIPE", "plumbing"), ("SITE", "site"), ("TTLB", "title_block"), ("NPLT", "construction"),
]
# Major group, minor group and role.
AIA_MINOR = [
    ("ANNO", "TEXT", "text"), ("ANNO", "NOTE", "text"), ("ANNO", "IDEN", "text"), ("ANNO", "DIMS", "dimension"),
    ("ANNO", "TTLB", "title_block"), ("ANNO", "PATT", "hatch"), ("AREA", "IDEN", "text"), ("FLOR", "PATT", "hatch"),
    ("FLOR", "TPTN", "casework"), ("FLOR", "STRS", "stair"), ("FLOR", "HRAL", "railing"),
    ("FLOR", "FIXT", "plumbing_fixture"), ("FLOR", "PFIX", "plumbing_fixture"), ("FLOR", "CASE", "casework"),
    ("FLOR", "APPL", "appliance"), ("FLOR", "EQPM", "equipment"), ("FLOR", "FURN", "furniture"),
    ("FLOR", "WDWK", "casework"), ("FLOR", "IDEN", "text"), ("FLOR", "AREA", "area"), ("FLOR", "EVTR", "stair"),
    ("WALL", "PATT", "hatch"),
]
# Element number and role.
ISO_ELEMENTS = [
    ("21", "wall"), ("22", "wall"), ("23", "floor"), ("24", "stair"), ("27", "roof"), ("28", "ceiling"),
    ("31", "window"), ("32", "door"), ("34", "railing"), ("37", "furniture"), ("41", "casework"),
    ("52", "plumbing"), ("61", "electrical"), ("71", "furniture"),
]
# Layer keyword pattern, role and confidence, first match wins.
LAYER_KEYWORDS = [
    (r"TITLE\s*BLOCK|TTLB|TITLEBLK|\bTBLK\b", "title_block", 0.9),
    (r"DIMENSION|\bDIMS?\b|\bDIM[-_]", "dimension", 0.9),
    (r"\bTEXT\b|\bTXT\b|\bLABEL|\bNOTES?\b|\bIDEN\b|ROOM[-_ ]?NAME|ROOM[-_ ]?TAG", "text", 0.88),
    (r"\bANNO|ANNOTATION|\bTAGS?\b|\bLEGEND\b|\bKEYNOTE", "annotation", 0.85),
    (r"\bGRID\b|GRIDLINE|COLUMN[-_ ]?GRID|\bAXIS\b", "grid", 0.85),
    (r"\bHATCH|\bPATT\b|PATTERN|\bFILL\b|POCHE", "hatch", 0.8),
    (r"DEFPOINTS|\bNPLT\b|NO[-_ ]?PLOT|CONSTRUCTION|\bTEMP\b|\bSCRATCH\b", "construction", 0.85),
    (r"VIEWPORT|\bVPORT\b|PAPER[-_ ]?SPACE|\bBORDER\b|SHEET", "title_block", 0.8),
    (r"WINDOW|\bGLAZ|GLAZING|CURTAIN[-_ ]?WALL|STOREFRONT|\bWIN\b|\bWDW\b", "window", 0.9),
    (r"\bDOORS?\b|\bDR\b|DOORWAY|\bOPENING", "door", 0.9),
    (r"COLUMN|\bCOLS?\b|\bPILLAR|\bPIER\b", "column", 0.88),
    (r"\bBEAMS?\b|\bJOIST|\bLINTEL|\bGIRDER", "beam", 0.85),
    (r"STAIR|\bSTRS\b|\bSTEPS?\b|ESCALATOR|\bRAMP\b", "stair", 0.88),
    (r"RAILING|HANDRAIL|BALUSTRADE|\bHRAL\b|\bGUARD\b", "railing", 0.85),
    (r"PARTITION|\bWALLS?\b|\bWALL[-_]|[-_]WALL\b|\bPARTN\b|MASONRY|BRICKWORK", "wall", 0.85),
    (r"ROOM[-_ ]?(BOUND|OUTLINE|POLY|AREA|EXTENT)|\bAREA[-_ ]?(POLY|BOUND)|SPACE[-_ ]?(BOUND|POLY)|\bRMBD\b", "room_boundary", 0.9),
    (r"\bAREAS?\b|\bZONE\b|\bSPACES?\b|\bRMS?\b|\bROOMS?\b", "area", 0.7),
    (r"PLUMB|\bPFIX\b|SANITARY|\bWC\b|TOILET|LAVATORY|\bBATH\b|SHOWER|\bSINK\b|BASIN|URINAL|BIDET", "plumbing_fixture", 0.88),
    (r"CASEWORK|\bCASE\b|CABINET|MILLWORK|JOINERY|COUNTERTOP|\bCOUNTER\b|\bSHELV|WARDROBE|CLOSET|\bTPTN\b", "casework", 0.85),
    (r"APPLIANCE|\bAPPL\b|REFRIGERAT|\bFRIDGE\b|\bOVEN\b|\bSTOVE\b|COOKTOP|DISHWASH|\bHOB\b", "appliance", 0.85),
    (r"FURNITURE|\bFURN\b|\bFF&E\b|\bFFE\b|\bMOBILIER\b|\bSEATING\b|\bDESKS?\b", "furniture", 0.88),
    (r"EQUIPMENT|\bEQPM\b|\bEQUIP\b|MACHINERY", "equipment", 0.8),
    (r"\bHVAC\b|DUCT|MECHANICAL|VENTILAT|\bAHU\b", "hvac", 0.85),
    (r"ELECTRIC|\bELEC\b|\bPOWR\b|\bPOWER\b|LIGHTING|\bLITE\b|SWITCH|SOCKET|\bOUTLET", "electrical", 0.85),
    (r"\bPIPE|DRAINAGE|\bWASTE\b|\bSOIL\b", "plumbing", 0.8),
    (r"CEILING|\bCLNG\b|\bRCP\b|SOFFIT", "ceiling", 0.85),
    (r"\bROOF\b|\bRF\b", "roof", 0.8),
    (r"\bFLOOR\b|\bFLOR\b|SLAB|SCREED|\bFFL\b", "floor", 0.8),
    (r"\bSITE\b|\bLANDSCAPE\b|\bPARKING\b|\bTOPO\b|CONTOUR|\bTREE\b", "site", 0.8),
]
# Category, kind, catalog category and block-name patterns, first match wins.
BLOCK_RULES = [
    ("north_arrow", "north_arrow", "", [r"\bNORTH\b", r"\bN ?ARROW\b", r"NORTH ?(ARROW|POINT|SIGN)", r"\bCOMPASS\b", r"\bNORD\b"]),
    ("title_block", "title_block", "", [r"TITLE ?BLOCK", r"\bTTLB\b", r"DRAWING ?(SHEET|BORDER)", r"\bA[0-4] ?SHEET\b"]),
    ("grid_bubble", "grid_bubble", "", [r"GRID ?(BUBBLE|HEAD|MARK)", r"\bCOL ?BUBBLE\b", r"\bDATUM\b"]),
    ("level_marker", "annotation", "", [r"LEVEL ?(MARK|TAG)", r"\bFFL\b", r"SPOT ?LEVEL", r"\bELEV ?MARK\b"]),
    ("section_marker", "annotation", "", [r"SECTION ?(MARK|ARROW|TAG)", r"\bDETAIL ?(MARK|BUBBLE)\b", r"\bCALL ?OUT\b"]),
    ("room_tag", "annotation", "", [r"ROOM ?(TAG|NAME|LABEL|STAMP)", r"\bRM ?TAG\b", r"SPACE ?TAG", r"\bAREA ?TAG\b"]),
    ("door", "door", "", [r"\bDOORS?\b", r"\bDR ?[0-9]", r"SINGLE ?DOOR", r"DOUBLE ?DOOR", r"SLIDING ?DOOR", r"\bD ?[0-9]{2}\b", r"\bSWING\b", r"FLUSH ?DOOR"]),
    ("window", "window", "", [r"\bWINDOWS?\b", r"\bWIN ?[0-9]", r"\bW ?[0-9]{2}\b", r"CASEMENT", r"\bGLAZING\b", r"\bSLIDING ?WIN", r"\bVENTILATOR\b", r"\bLOUVER"]),
    ("column", "column", "", [r"\bCOLUMNS?\b", r"\bCOL ?[0-9]", r"\bRCC ?COL", r"\bPILLAR\b"]),
    ("stair", "stair", "", [r"\bSTAIR", r"\bSTEPS?\b", r"\bFLIGHT\b", r"\bTREAD\b", r"\bLIFT\b", r"\bELEVATOR\b"]),
    ("light_fixture", "electrical", "", [r"\bLIGHT\b", r"\bLUMIN", r"\bLAMP\b", r"\bDOWN ?LIGHT\b", r"\bFAN\b", r"\bSWITCH\b", r"\bSOCKET\b", r"\bOUTLET\b", r"\bDB\b"]),
    ("toilet", "plumbing_fixture", "", [r"\bWC\b", r"\bW C\b", r"TOILET", r"\bWATER CLOSET\b", r"\bLOO\b", r"\bPAN\b(?! ?HEAD)", r"\bCOMMODE\b", r"\bEWC\b"]),
    ("urinal", "plumbing_fixture", "", [r"URINAL", r"\bURN\b"]),
    ("bidet", "plumbing_fixture", "", [r"BIDET"]),
    ("washbasin", "plumbing_fixture", "", [r"WASH ?BASIN", r"\bBASIN\b", r"\bLAVATORY\b", r"\bLAV\b", r"HAND ?WASH", r"\bVANITY\b", r"WASH ?HAND"]),
    ("bathtub", "plumbing_fixture", "", [r"BATH ?TUB", r"\bBATHTUB\b", r"\bTUB\b", r"\bBATH\b(?! ?ROOM)", r"\bJACUZZI\b", r"SOAK(ER|ING)? ?TUB"]),
    ("shower", "plumbing_fixture", "", [r"\bSHOWER\b", r"\bSHR\b", r"SHOWER ?TRAY", r"SHOWER ?CUBICLE", r"\bWET ?ROOM\b"]),
    ("floor_drain", "plumbing_fixture", "", [r"FLOOR ?DRAIN", r"\bFD\b", r"\bGULLY\b"]),
    ("water_heater", "plumbing_fixture", "", [r"WATER ?HEATER", r"\bGEYSER\b", r"\bBOILER\b", r"\bCYLINDER\b"]),
    ("sink", "kitchen_fixture", "", [r"KITCHEN ?SINK", r"\bSINK\b", r"\bSK\b(?! ?LIGHT)", r"DOUBLE ?BOWL"]),
    ("cooktop", "kitchen_fixture", "", [r"COOK ?TOP", r"\bHOB\b", r"\bSTOVE\b", r"\bRANGE\b(?! ?HOOD)", r"\bBURNER", r"\bCHULHA\b", r"GAS ?TOP"]),
    ("oven", "appliance", "oven", [r"\bOVEN\b", r"\bMICROWAVE\b(?! ?SHELF)", r"\bMWO\b"]),
    ("range_hood", "kitchen_fixture", "", [r"RANGE ?HOOD", r"\bCHIMNEY\b", r"EXTRACT(OR)? ?HOOD", r"\bCOOKER ?HOOD\b"]),
    ("refrigerator", "appliance", "refrigerator", [r"REFRIGERAT", r"\bFRIDGE\b", r"\bFREEZER\b", r"\bREF\b(?! ?LINE)"]),
    ("dishwasher", "appliance", "", [r"DISH ?WASHER", r"\bDW\b(?! ?G)"]),
    ("washing_machine", "appliance", "washing_machine", [r"WASHING ?MACHINE", r"\bWASHER\b", r"\bWM\b", r"\bLAUNDRY\b", r"CLOTHES ?DRYER", r"\bTUMBLE ?DRY"]),
    ("kitchen_counter", "casework", "kitchen_counter", [r"COUNTER ?TOP", r"\bCOUNTER\b", r"\bWORKTOP\b", r"PLATFORM", r"KITCHEN ?PLAT", r"\bSLAB ?UNIT\b"]),
    ("kitchen_island", "casework", "kitchen_island", [r"\bISLAND\b", r"KITCHEN ?IS"]),
    ("bed", "furniture", "bed", [r"\bBED\b(?! ?ROOM)", r"DOUBLE ?BED", r"SINGLE ?BED", r"QUEEN ?BED", r"KING ?BED", r"\bBED ?[0-9]", r"\bCOT\b", r"\bBUNK\b", r"\bMATTRESS\b"]),
    ("bedside_table", "furniture", "bedside_table", [r"BED ?SIDE", r"NIGHT ?STAND", r"NIGHT ?TABLE", r"\bBST\b"]),
    ("wardrobe", "casework", "wardrobe", [r"WARD ?ROBE", r"\bWDR\b", r"\bALMIRAH\b", r"\bCLOSET\b", r"\bARMOIRE\b", r"\bCUPBOARD\b", r"\bCUPB\b", r"\bCLOS\b"]),
    ("dressing_table", "furniture", "console_table", [r"DRESS(ING)? ?TABLE", r"\bDRESSER\b", r"\bVANITY ?UNIT\b"]),
    ("sofa", "furniture", "sofa", [r"\bSOFA\b", r"\bCOUCH\b", r"\bSETTEE\b", r"\bLOVE ?SEAT\b"]),
    ("sectional", "furniture", "sectional", [r"SECTIONAL", r"\bL ?SHAPE ?SOFA\b"]),
    ("armchair", "furniture", "armchair", [r"ARM ?CHAIR", r"\bRECLINER\b", r"EASY ?CHAIR", r"\bLOUNGER\b"]),
    ("coffee_table", "furniture", "coffee_table", [r"COFFEE ?TABLE", r"\bCTR ?TABLE\b", r"CENTRE ?TABLE", r"CENTER ?TABLE"]),
    ("dining_table", "furniture", "dining_table", [r"DINING ?TABLE", r"\bDIN ?TABLE\b", r"\bDINETTE\b", r"\bDT ?[0-9]"]),
    ("dining_chair", "furniture", "dining_chair", [r"DINING ?CHAIR", r"\bDIN ?CHAIR\b"]),
    ("office_chair", "furniture", "office_chair", [r"OFFICE ?CHAIR", r"SWIVEL ?CHAIR", r"TASK ?CHAIR", r"EXEC(UTIVE)? ?CHAIR"]),
    ("study_table", "furniture", "study_table", [r"STUDY ?TABLE", r"\bDESK\b", r"WORK ?STATION", r"WORK ?TABLE", r"COMPUTER ?TABLE", r"WRITING ?TABLE"]),
    ("bookshelf", "casework", "bookshelf", [r"BOOK ?SHELF", r"BOOK ?CASE", r"\bSHELV(ING|ES)\b", r"\bRACK\b"]),
    ("tv_unit", "furniture", "tv_unit", [r"\bTV ?UNIT\b", r"MEDIA ?(UNIT|CONSOLE)", r"\bTV ?CAB", r"ENTERTAIN"]),
    ("tv", "furniture", "tv", [r"\bTV\b", r"TELEVISION", r"\bLED ?TV\b"]),
    ("side_table", "furniture", "side_table", [r"SIDE ?TABLE", r"\bEND ?TABLE\b"]),
    ("chair", "furniture", "chair", [r"\bCHAIRS?\b", r"\bCHR\b", r"\bSEAT\b"]),
    ("table", "furniture", "dining_table", [r"\bTABLES?\b", r"\bTBL\b"]),
    ("stool", "furniture", "stool", [r"\bSTOOL\b", r"\bBAR ?STOOL\b"]),
    ("sideboard", "casework", "sideboard", [r"SIDE ?BOARD", r"\bCREDENZA\b", r"\bBUFFET\b", r"CROCKERY"]),
    ("cabinet", "casework", "cabinet", [r"\bCABINET\b", r"\bCAB\b(?! ?LE)", r"\bSTORAGE\b", r"\bLOCKER\b"]),
    ("plant", "furniture", "plant", [r"\bPLANT\b", r"\bPLANTER\b", r"\bPOT\b", r"\bSHRUB\b"]),
    ("rug", "furniture", "rug", [r"\bRUG\b", r"\bCARPET\b", r"\bMAT\b"]),
    ("piano", "furniture", "", [r"\bPIANO\b", r"\bGRAND ?PIANO\b"]),
    ("car", "furniture", "", [r"\bCARS?\b(?! ?PET)", r"\bVEHICLE\b", r"\bPARKING\b"]),
]
# Tags that may name a room, and tags that may state its area, in order.
ROOM_NAME_TAGS = ["ROOM", "ROOM_NAME", "ROOMNAME", "RM_NAME", "NAME", "SPACE", "SPACE_NAME", "ROOM_TYPE", "USE", "FUNCTION", "LABEL", "DESCRIPTION"]
AREA_TAGS = ["AREA", "ROOM_AREA", "SQ_M", "SQM", "SQFT", "SQ_FT", "SIZE"]
# Header code, metres per unit, name.
INSUNITS = [
    (1, 0.0254, "inches"), (2, 0.3048, "feet"), (3, 1609.344, "miles"), (4, 0.001, "millimetres"),
    (5, 0.01, "centimetres"), (6, 1.0, "metres"), (7, 1000.0, "kilometres"), (8, 2.54e-08, "microinches"),
    (9, 2.54e-05, "mils"), (10, 0.9144, "yards"), (11, 1e-10, "angstroms"), (12, 1e-09, "nanometres"),
    (13, 1e-06, "microns"), (14, 0.1, "decimetres"), (15, 10.0, "decametres"), (16, 100.0, "hectometres"),
    (17, 1000000000.0, "gigametres"), (20, 149597870700.0, "astronomical units"),
]
# Labels that say nothing about a place, and phrases of drawing boilerplate.
UNINFORMATIVE = ["", "1", "2", "3", "4", "A", "B", "C", "D", "DN", "DOWN", "E", "FIRST FLOOR", "FLOOR PLAN", "GROUND FLOOR", "LEVEL", "N", "NORTH", "NTS", "PLAN", "REF", "S", "SCALE", "TYP", "UP", "W"]
BOILERPLATE = ["SCALE", "DRAWN BY", "CHECKED", "DIMENSIONS IN", "FLOOR PLAN", "SITE PLAN", "DRAWING NO", "DWG NO", "SHEET", "REVISION", "CLIENT", "PROJECT", "TITLE", "DO NOT SCALE", "ALL LEVELS", "NOTES"]

define("dim_aia_disciplines", "discipline", AIA_DISCIPLINES)
define("dim_aia_major", "major role", AIA_MAJOR)
define("dim_aia_minor", "major minor role", AIA_MINOR)
define("dim_iso_elements", "element role", ISO_ELEMENTS)
define("dim_insunits", "insunits scale unit_name", INSUNITS)
define("dim_room_parents", "specific parent", ROOM_PARENTS)
