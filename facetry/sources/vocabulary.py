"""Fixed lists of the food profiles, as small tables for the rule and key operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Spelling variants of ingredient keys.
INGREDIENT_ALIAS = {
    "saltfish": "salt_fish", "sugarcane": "sugar_cane", "rosewater": "rose_water", "bananas": "banana",
    "chestnuts": "chestnut", "peaches": "peach", "cucumbers": "cucumber", "walnuts": "walnut", "tomatoes": "tomato",
    "chickpeas": "chickpea", "mussels": "mussel", "tropical_fruits": "tropical_fruit", "carrots": "carrot",
    "peanuts": "peanut", "leeks": "leek", "beans": "bean", "fruits": "fruit", "melons": "melon",
    "groundnuts": "groundnut", "eggs": "egg", "bamboo_shoots": "bamboo_shoot", "sweet_potatoes": "sweet_potato",
    "potatoes": "potato", "barberries": "barberry", "pistachios": "pistachio", "green_bananas": "green_banana",
    "peppers": "pepper", "hazelnuts": "hazelnut", "lemons": "lemon", "cherries": "cherry", "plantains": "plantain",
    "lingonberries": "lingonberry", "anchovies": "anchovy", "limes": "lime", "pears": "pear", "plums": "plum",
    "apricots": "apricot", "grapes": "grape", "dates": "date", "prunes": "prune", "raisins": "raisin",
    "mulberries": "mulberry", "blueberries": "blueberry", "cranberries": "cranberry", "figs": "fig",
    "olives": "olive", "onions": "onion", "chile": "chili", "chilies": "chili", "chili_pepers": "chili_peppers",
}
METHOD_ALIAS = {"rosting": "roasting", "strewing": "stewing"}

# The longer list of scores that mark machine-filled data.
FILLER_SET_LONG = (
    0.44, 0.4656, 0.4386, 0.4325, 0.4086, 0.3694, 0.3596, 0.3462, 0.3446, 0.3386, 0.3224, 0.314, 0.3079,
    0.2949, 0.2892, 0.2698, 0.2446, 0.2131, 0.206, 0.1757, 0.1723, 0.1555, 0.1402, 0.1123, 0.0844, 0.0746,
)

# The four dimensions every profile should cover.
DIMENSIONS = {
    "starch": (
        "rice", "wheat", "corn", "potato", "cassava", "flatbread", "teff", "quinoa", "millet", "sorghum", "noodle",
        "oat", "barley", "rye_bread", "bulgur", "couscous", "injera", "ugali", "cornmeal", "bread",
        "taro", "yam", "breadfruit", "plantain"),
    "protein": (
        "beef", "pork", "lamb", "fish", "chicken", "bean", "lentil", "tofu", "egg", "chickpea", "mussel", "shrimp",
        "crab", "duck", "horse_meat", "camel", "pigeon", "goat", "tuna", "anchovy", "herring", "cod", "catfish",
        "mutton", "rabbit", "venison", "octopus", "crayfish", "goat_meat", "camel_meat", "yak_meat", "veal",
        "tilapia", "kangaroo", "barramundi", "river_fish", "smoked_fish", "smoked_meat", "reindeer_meat",
        "seal_meat", "game_meat"),
    "fat": (
        "olive_oil", "butter", "ghee", "coconut_oil", "palm_oil", "lard", "sesame_oil", "sunflower_oil",
        "coconut_milk", "cream", "mustard_oil", "chili_oil", "coconut", "sour_cream"),
    "aromatics": (
        "garlic", "ginger", "onion", "shallot", "scallion", "leek", "green_onion", "chive", "lemongrass", "galangal"),
}
# Keys that only the data check, not the build-time check, accepts.
CHECK_ONLY = (
    "taro", "yam", "breadfruit", "plantain", "goat_meat", "camel_meat", "yak_meat", "veal", "tilapia", "kangaroo",
    "barramundi", "river_fish", "smoked_fish", "smoked_meat", "reindeer_meat", "seal_meat", "game_meat")

# Countries of each regional rule and the keys of which one must be present.
REGIONAL = {
    "mediterranean_olive_oil": (
        ("GR", "TR", "IT", "ES", "PT", "FR", "LB", "SY", "IQ", "IL", "PS", "EG", "LY", "TN", "DZ", "MA", "MT", "HR",
         "BA", "RS", "ME", "AL"), ("olive_oil",)),
    "asian_starch": (
        ("CN", "JP", "KR", "TH", "VN", "MM", "KH", "LA", "ID", "MY", "SG", "PH", "TW", "HK"), ("rice", "noodle")),
    "african_starch": (
        ("NG", "GH", "CI", "SN", "CM", "CD", "GN", "MZ", "TZ", "KE", "UG", "RW", "AO", "ZM", "ZW", "MW", "BJ", "TG",
         "BF", "ML", "NE", "GA", "CG", "SS"), ("palm_oil", "cassava", "yam")),
}


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [("ing", k, v) for k, v in INGREDIENT_ALIAS.items()] + [("met", k, v) for k, v in METHOD_ALIAS.items()]
    return spark.createDataFrame(rows, "kind string, raw_key string, canonical string")


def dimension_table(spark: SparkSession, build_time: bool = False) -> DataFrame:
    """(dimension, feature); ``build_time`` gives the shorter lists of the build check."""
    rows = [(d, f) for d, names in DIMENSIONS.items() for f in names if not (build_time and f in CHECK_ONLY)]
    return spark.createDataFrame(rows, "dimension string, feature string")


def regional_table(spark: SparkSession) -> DataFrame:
    rows = [(rule, g, f) for rule, (groups, keys) in REGIONAL.items() for g in groups for f in keys]
    return spark.createDataFrame(rows, "rule string, group string, feature string")
