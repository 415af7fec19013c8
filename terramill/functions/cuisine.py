"""Cuisine tags: splitting, normalising, facets and the choice of one cuisine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terramill.functions.text import deaccent, strip

# Facet vocabularies, synonyms, suffixes and separators of cuisine tags.
REGIONAL = [
    "japanese", "chinese", "korean", "vietnamese", "thai", "indian", "pakistani", "indonesian", "filipino", "cambodian", "malaysian", "asian",
    "oriental", "french", "italian", "spanish", "portuguese", "greek", "german", "english", "swiss", "austrian", "belgian", "dutch", "hungarian",
    "polish", "russian", "balkan", "basque", "corsican", "savoyard", "alsatian", "mediterranean", "american", "mexican", "argentinian", "brazilian",
    "peruvian", "cuban", "caribbean", "tex-mex", "cajun", "lebanese", "turkish", "moroccan", "tunisian", "algerian", "syrian", "iranian", "afghan",
    "georgian", "armenian", "israeli", "african", "ethiopian", "senegalese",
]
DISH = [
    "pizza", "pasta", "burger", "sandwich", "kebab", "tacos", "sushi", "ramen", "noodle", "poke", "bowl", "dumpling", "dim_sum", "curry", "seafood",
    "fish", "chicken", "steak_house", "grill", "barbecue", "rotisserie", "friture", "crepe", "galette", "tapas", "fondue", "raclette", "salad",
    "soup", "fish_and_chips", "hot_dog", "bagel", "wings", "empanada", "wok", "teppanyaki",
]
VENUE = [
    "coffee_shop", "cafe", "bar", "pub", "wine_bar", "beer", "brewery", "ice_cream", "bakery", "pastry", "chocolate", "donut", "cake", "dessert",
    "bubble_tea", "tea", "juice", "smoothie", "breakfast", "brunch", "snack", "fast_food", "bistro", "brasserie", "food_court", "diner", "buffet",
]
DIET = [
    "vegan", "vegetarian", "halal", "kosher", "gluten_free", "organic", "bio",
]
SYNONYMS = {
    "francaise": "french", "italienne": "italian", "italien": "italian", "chinoise": "chinese", "chinois": "chinese",
    "japonaise": "japanese", "japonais": "japanese", "indienne": "indian", "libanaise": "lebanese", "grecque": "greek",
    "vietnamienne": "vietnamese", "coreenne": "korean", "coreen": "korean", "marocaine": "moroccan",
    "espagnole": "spanish", "portugaise": "portuguese", "turque": "turkish",
    "sushi_bar": "sushi", "steak": "steak_house", "steakhouse": "steak_house", "bbq": "barbecue", "burgers": "burger",
    "hamburger": "burger", "noodles": "noodle", "pastas": "pasta", "pizzas": "pizza", "coffee": "coffee_shop",
    "coffeeshop": "coffee_shop", "cofee_shop": "coffee_shop", "icecream": "ice_cream", "glacier": "ice_cream",
    "boulangerie": "bakery", "patisserie": "pastry", "salon_de_the": "tea", "the": "tea", "veg": "vegetarian",
    "veggie": "vegetarian",
}
SUFFIXES = ["_restaurant", "_restaurants", "_food", "_cuisine", "_place", "_house"]
SEPARATORS = "[;,/|]"
FACETS = {"regional": REGIONAL, "dish": DISH, "venue": VENUE, "diet": DIET}


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for item in entries.items() for v in item])


def normalize_token(token: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Canonical form of one raw token; null stays null, noise becomes ''."""
    t = deaccent(F.lower(strip(token)))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\s-]+", "_"), r"[^a-z0-9_]", ""), "_+", "_")
    t = F.regexp_replace(t, "^_|_$", "")
    # the first suffix of the list that ends the token is cut, if something is left
    t = F.regexp_replace(t, f"^(.+?)(?:{'|'.join(SUFFIXES)})$", "$1")
    return F.coalesce(F.try_element_at(_literal_map(SYNONYMS | (synonyms or {})), t), t)


def split_tags(raw: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Normalised tokens without blanks and repeats, in order; null and blank give an empty list."""
    tokens = F.transform(F.split(raw, SEPARATORS), lambda t: normalize_token(t, synonyms))
    return F.coalesce(F.array_distinct(F.filter(tokens, lambda t: t != "")), F.array().cast("array<string>"))


def facet_of(token: Column) -> Column:
    """regional, dish, venue, diet or unknown; the first facet of this order that names the token."""
    table = {t: name for name, tokens in reversed(FACETS.items()) for t in tokens}
    return F.coalesce(F.try_element_at(_literal_map(table), token), F.lit("unknown"))


def group_by_facet(tokens: Column) -> Column:
    """MAP facet -> tokens of it, in order."""
    facets = F.array_distinct(F.transform(tokens, facet_of))
    return F.map_from_entries(F.transform(facets, lambda f: F.struct(f, F.filter(tokens, lambda t: facet_of(t) == f))))


def first_of(tokens: Column, facet: str) -> Column:
    return F.get(F.filter(tokens, lambda t: facet_of(t) == facet), F.lit(0))


def pick_cuisine(tokens: Column, keep_venue: bool = False, prefer: str = "regional") -> Column:
    """First token of the first facet in order of priority; null if none has one."""
    order = (["dish", "regional"] if prefer == "dish" else ["regional", "dish"]) + (["venue"] if keep_venue else [])
    return F.coalesce(*[first_of(tokens, facet) for facet in order])


def classify_cuisine(df: DataFrame, column: str = "cuisine", keep_venue: bool = False, prefer: str = "regional", synonyms: dict[str, str] | None = None) -> DataFrame:
    """Adds <column>_tokens and <column>_facets and replaces the column by its cuisine, written without underscores.

    ``synonyms``: further spellings; their keys are taken in canonical form.
    """
    tokens = f"{column}_tokens"
    df = df.withColumn(tokens, split_tags(F.col(column), synonyms)).withColumn(f"{column}_facets", group_by_facet(F.col(tokens)))
    return df.withColumn(column, F.replace(pick_cuisine(F.col(tokens), keep_venue, prefer), F.lit("_"), F.lit("")))


def unknown_report(df: DataFrame, column: str = "cuisine") -> DataFrame:
    """(token, count) of the tokens that no facet names, most frequent first."""
    tokens = df.select(F.explode(split_tags(F.col(column))).alias("token")).where(facet_of(F.col("token")) == "unknown")
    return tokens.groupBy("token").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "token")


def coverage_report(df: DataFrame, column: str = "cuisine", **options) -> DataFrame:
    """One row: n_pois, with_cuisine, without_cuisine, coverage (3 decimals, 0 without rows)."""
    found = F.count(pick_cuisine(split_tags(F.col(column)), **options))
    every = F.count("*")
    return df.agg(every.alias("n_pois"), found.alias("with_cuisine"), (every - found).alias("without_cuisine"), F.coalesce(F.round(F.try_divide(found, every), 3), F.lit(0.0)).alias("coverage"))


def closest_known(df: DataFrame, token: str = "token", threshold: float = 0.75, encoder=None) -> DataFrame:
    """(token, proposed, facet, score): the known token most like each unknown one, null below the threshold.

    Likeness is 1 - edit distance / longer length; ``encoder``, a vectorised UDF
    from text to ARRAY<DOUBLE>, replaces it by the cosine. The vocabulary is fixed.
    """
    known = sorted({t for tokens in FACETS.values() for t in tokens})
    rows = df.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct()
    if encoder is None:
        score = lambda k: 1 - F.levenshtein("token", k) / F.greatest(F.length("token"), F.length(k), F.lit(1))
        best = F.array_max(F.transform(F.array(*map(F.lit, known)), lambda k: F.struct(score(k).alias("score"), k.alias("known"))))
        rows = rows.withColumn("best", best)
    else:
        rows = rows.withColumn("proposed", F.explode(F.array(*map(F.lit, known)))).withColumns({"a": encoder("token"), "b": encoder("proposed")})
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn("score", F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))))
        rows = rows.groupBy("token").agg(F.max(F.struct("score", F.col("proposed").alias("known"))).alias("best"))
    accepted = F.when(F.col("best.score") >= threshold, F.col("best.known"))
    return rows.select("token", accepted.alias("proposed"), facet_of(accepted).alias("facet"), F.round("best.score", 3).alias("score")).orderBy(F.desc("score"), "token")
