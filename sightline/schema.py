"""Record schemas, the class universe, and the fixed tables of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Classes, in id order.
CLASSES = ["pedestrian", "rider", "car", "truck", "bus", "two_wheeler", "traffic_light", "traffic_sign"]
# Source labels to classes; other labels are dropped.
LABELS = {
    "pedestrian": "pedestrian",
    "other person": "pedestrian",
    "rider": "rider",
    "car": "car",
    "truck": "truck",
    "bus": "bus",
    "bicycle": "two_wheeler",
    "motorcycle": "two_wheeler",
    "traffic light": "traffic_light",
    "traffic sign": "traffic_sign",
}
# Source times of day; others become undefined.
TIMES_OF_DAY = {"daytime": "day", "night": "night", "dawn/dusk": "dawn"}
# Matching thresholds and area ranges (both ends count).
THRESHOLDS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETECTIONS = 100
GATED_IMAGES = 25
# Slices as SQL predicates over an image's attributes.
SLICES = {
    "overall": "true",
    "day": "timeofday = 'day'",
    "night": "timeofday = 'night'",
    "dawn": "timeofday = 'dawn'",
    "clear": "weather = 'clear'",
    "overcast": "weather in ('overcast', 'partly_cloudy')",
    "rainy": "weather = 'rainy'",
    "snowy": "weather = 'snowy'",
    "night_rainy": "timeofday = 'night' and weather = 'rainy'",
    "highway": "scene = 'highway'",
    "city_street": "scene = 'city_street'",
}
# Scene and object concepts, and the scene concepts that images can be made for.
SCENE_CONCEPTS = ["night", "dusk", "daylight", "overcast", "rain", "snow", "fog", "glare", "tunnel"]
OBJECT_CONCEPTS = ["dark_object", "tiny", "blurry", "occluded", "light_source", "crowd", "clear_object"]
CONDITIONS = ["night", "dusk", "rain", "snow", "fog", "glare"]
# Attributes that an image made for a condition takes on.
CONDITION_ATTRS = {
    "night": {"timeofday": "night"},
    "dusk": {"timeofday": "dawn"},
    "glare": {"timeofday": "night"},
    "rain": {"weather": "rainy"},
    "snow": {"weather": "snowy"},
    "fog": {"weather": "foggy"},
}
# What prompts are put together from: a start, scenes, recipes of a condition, an end, and what is not wanted.
PROMPT_START, PROMPT_END = "a realistic dashcam photo of a", "photorealistic, 4k, sharp focus, natural colors"
PROMPT_SCENES = {
    "city_street": "city street",
    "highway": "highway",
    "residential": "residential street",
    "parking_lot": "parking lot",
    "tunnel": "tunnel",
    "gas_stations": "gas station",
}
PROMPT_RECIPES = {
    "night": [
        "at night, dark sky, street lights, glowing car headlights and red tail lights",
        "at night, dimly lit, sodium street lamps, light reflections on the road",
        "late at night, very dark, only headlights and shop lights illuminate the street",
    ],
    "dusk": [
        "at dusk, twilight sky, low orange sun, long shadows, headlights on",
        "at dawn, soft blue light, low contrast, street lights still on",
    ],
    "rain": [
        "in heavy rain, wet reflective asphalt, raindrops on the windshield, grey sky",
        "on a rainy evening, puddles, blurry reflections, spray from cars",
    ],
    "snow": ["in winter, snow on the road and sidewalks, falling snow, overcast", "during a snowstorm, snow-covered cars, white sky"],
    "fog": ["in dense fog, hazy, low visibility, washed-out colors"],
    "glare": ["at night with strong oncoming headlight glare, lens flare, bright light streaks"],
}
PROMPT_UNWANTED = "cartoon, painting, illustration, cgi, render, anime, deformed, lowres, text, watermark, logo, frame"
PROMPT_UNWANTED_IN = {
    "night": "daylight, sunny, blue sky, bright day",
    "dusk": "midday, harsh noon sun",
    "rain": "dry road, sunny",
    "snow": "summer, green trees",
    "fog": "clear sky, crisp",
    "glare": "daylight, sunny",
}
# Slices that may stand in for targets, with the condition that images are made for.
FALLBACK_CONDITIONS = {"night": "night", "dawn": "dusk", "rainy": "rain", "snowy": "snow"}

BOX = T.StructType(
    [T.StructField("cls", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]
    + [T.StructField("occluded", T.BooleanType()), T.StructField("truncated", T.BooleanType())]
)
SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("boxes", T.ArrayType(BOX)),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)
