"""Fixed values that results depend on. They are data, listed plainly in natural order."""

# Land-cover codes, class 1 for the first code up to class 55 for the last.
LAND_COVER_CODES = [
    "110", "111", "112", "113", "114", "120", "121", "122", "123", "130", "140", "150", "160", "161", "162", "163", "170", "171", "172",
    "210", "220", "230", "231", "232", "233", "234", "235", "236", "240", "250", "260",
    "310", "311", "312", "313", "320", "330", "340", "350", "351", "352", "353", "354",
    "410", "411", "412", "413", "414", "510", "511", "512", "513", "514", "515", "516",
]

# Roughness of class 0 (default) and of classes 1..55.
ROUGHNESS_DEFAULT = 0.050
ROUGHNESS = [
    0.050,
    0.080, 0.120, 0.100, 0.060, 0.050, 0.040, 0.040, 0.050, 0.040, 0.060, 0.060,
    0.045, 0.020, 0.015, 0.030, 0.020, 0.050, 0.040, 0.050, 0.035, 0.025, 0.050,
    0.045, 0.045, 0.040, 0.045, 0.050, 0.055, 0.035, 0.040, 0.045, 0.100, 0.110,
    0.120, 0.115, 0.035, 0.070, 0.080, 0.025, 0.015, 0.035, 0.060, 0.025, 0.040,
    0.050, 0.060, 0.045, 0.020, 0.025, 0.030, 0.020, 0.020, 0.015, 0.020, 0.010,
]

# Land-cover classes that count as water, and the sea class.
WATER_CLASSES = [47, 48, 49, 50, 51, 52, 53, 54]
SEA_CLASS = 54

# Risk levels as (level, name, threshold in metres); level 0 is the default.
LEVELS = [
    (0, "Dry", 0.0),
    (1, "Very Shallow", 0.2),
    (2, "Low Depth", 0.4),
    (3, "Medium Depth", 0.6),
    (4, "High Depth", 1.0),
    (5, "Extreme Depth", 2.0),
]

# Default palette as (value, label, hex, red, green, blue, alpha).
PALETTE = [
    (0, "Dry", "#9E8050", 158, 128, 80, 255),
    (1, "Very Shallow", "#99E6FF", 153, 230, 255, 255),
    (2, "Low Depth", "#3399E6", 51, 153, 230, 255),
    (3, "Medium Depth", "#1A66CC", 26, 102, 204, 255),
    (4, "High Depth", "#0D33B3", 13, 51, 179, 255),
    (5, "Extreme Depth", "#1A1A99", 26, 26, 153, 255),
]

# State names in messages.
STATE_NAMES = {
    "DRY": 0,
    "VERY_SHALLOW": 1,
    "LOW_DEPTH": 2,
    "MEDIUM_DEPTH": 3,
    "FLOODED": 3,
    "HIGH_DEPTH": 4,
    "EXTREME_DEPTH": 5,
    "OBSTACLE_DESTROYED": 0,
    "OPEN": 0,
}

# Elevation bands as (upper limit in metres, red, green, blue).
ELEVATION_BANDS = [
    (-10.0, 20, 60, 150),
    (0.0, 50, 100, 180),
    (5.0, 210, 195, 145),
    (30.0, 185, 205, 130),
    (100.0, 140, 170, 90),
    (300.0, 130, 110, 75),
    (9999.0, 200, 190, 180),
]

# Defaults of the message format.
CHUNK_CELLS = 40000
CHUNKS_PER_BATCH = 10
PING_WAIT_SECONDS = 10
FRAME_LIMIT_SECONDS = 720
DELTA_LAYER = "topo_bathy"
TERRAIN_LAYER = "topo_bathy"
DEPTH_LAYER = "water_depth"

# Half the circumference of the web-mercator sphere and its tile side in pixels.
MERCATOR_HALF = 20037508.3427892
TILE_PIXELS = 256
