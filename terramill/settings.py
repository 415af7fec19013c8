"""Perimeter and vocabularies of the point-of-interest corpus; every function takes them as parameters."""

# Map tags by kind, bounding boxes (west, south, east, north) in degrees, name tags, excluded categories.
CATEGORIES = {
    "amenity": ["cafe", "restaurant", "bar", "pub", "park"],
    "tourism": ["hotel"],
    "railway": ["station", "subway_entrance"],
    "leisure": ["park", "nature_reserve", "garden"],
    "landuse": ["grass"],
}
STREETS_TAGS = {"highway": ["primary", "secondary", "tertiary", "unclassified", "residential", "pedestrian", "living_street"]}
AREA_TAGS = {"leisure": ["park", "nature_reserve", "garden"], "boundary": ["administrative"]}
CATEGORY_TAGS = ["amenity", "shop", "tourism", "leisure", "station", "public_transport", "railway"]
NAME_TAGS = ["poi_name", "name", "name:fr", "brand", "operator", "alt_name"]
EXCLUDED = ["bench", "waste_basket", "bicycle_parking", "vending_machine", "yes", "parking_space", "ticket_validator", "recycling"]
BOXES = {"all": (2.24, 48.8, 2.41, 48.9), "test": (2.346, 48.853, 2.362, 48.862), "west": (2.24, 48.8156, 2.3470, 48.9022), "east": (2.3470, 48.8156, 2.41, 48.9022)}
