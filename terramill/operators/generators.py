"""Question sets of the twelve templates.

A generator looks at the candidates of each stratum in the order of a seeded hash,
answers them by one relation, and takes those with answers: as many as asked for,
if there are as many. What a stratum lacks comes from the others; ``shortfall``
reports what can't be had. Only as many candidates are looked at as it takes. Rows
have query, category_query, function, the context columns of the template and
four parallel answer lists, ranked from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramill.functions import geometry as G
from terramill.operators import corpus
from terramill.operators import relations as R
from terramill.operators.sampling import draw_order, first_answered, per_group
from terramill.operators.search import Index, radius_join
from terramill.session import Scratch

# Distances; so are the wording of the questions (two blanks in street_cross) and the names of the columns below.
DISTANCES = [100, 300, 500, 1000]
DIRECTIONS = list(G.CARDINAL)


@dataclass(frozen=True)
class World:
    """What questions are made about: places (``corpus.pois``), areas and streets, the asked categories (all of the places' if none are given) and the seed."""

    places: DataFrame
    areas: DataFrame | None = None
    streets: DataFrame | None = None
    categories: list[str] | None = None
    seed: int = 42

    def __post_init__(self):
        if self.categories is None:
            object.__setattr__(self, "categories", corpus.categories(self.places))

    @cached_property
    def index(self) -> Index:
        """The places for ranked searches, prepared once for all templates."""
        return Index(self.places).keep(R.K)

    def named(self) -> DataFrame:
        return self.places.where("poi_name IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND category IS NOT NULL")

    def scratch(self) -> Scratch:
        return Scratch(self.places.sparkSession, "questions")

    def by_category(self, ratio: dict | None = None) -> list[tuple[int, float]]:
        """Strata of the categories, equal ones unless ratios are given."""
        return [(i, float((ratio or {}).get(c, 0.0 if ratio else 1.0))) for i, c in enumerate(self.categories)]

    def for_each_category(self, rows: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("stratum"), F.lit(c).alias("category")) for i, c in enumerate(self.categories)])
        return rows.select("*", F.inline(each))

    def first(self, rows: DataFrame, order: list[str], depth: int) -> DataFrame:
        """The first rows of the draw by ``order``, numbered from 1."""
        drawn = rows.orderBy(draw_order(self.seed, *order), *order).limit(depth)
        return drawn.withColumn("place", F.row_number().over(Window.orderBy(draw_order(self.seed, *order), *order)))  # depth rows


def pack(asked: DataFrame, answers: DataFrame, key: list[str], places: DataFrame, function: str, query: Column) -> DataFrame:
    """Asked rows that have answers, with the four lists; ``answers``: key, poi_id, dist, rank."""
    names = places.select("poi_id", "poi_name")
    item = F.struct(F.col("rank"), F.col("poi_id"), F.col("poi_name"), F.col("dist"))
    lists = answers.join(names, "poi_id").groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = asked.join(lists, key)
    context = [c for c in rows.columns if c not in ("items", "category", "stratum")]
    return rows.select(
        query.alias("query"), F.col("category").alias("category_query"), F.lit(function).alias("function"), *context, F.col("items.poi_id").alias("results_poi_id"),
        F.col("items.poi_name").alias("results_poi_name"), F.col("items.dist").alias("results_poi_dist"), F.transform("items", lambda i: i["rank"].cast("int")).alias("results_poi_rank"),
    )


def anchor_cells(categories: list[str]) -> list[tuple[str, str]]:
    """Pairs of anchor and asked category, by cyclic diagonals."""
    return [(c, categories[(i + s) % len(categories)]) for s in range(len(categories)) for i, c in enumerate(categories)]


def _anchored(w: World, nb_q: int, ratio: dict | None, answer: Callable[[DataFrame], DataFrame], extra: str | None = None, values: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Drawn questions about anchors, with their answers. Strata are the cells, times the values of an extra column."""
    cells = [(a, c, v) for a, c in anchor_cells(w.categories) for v in (values or [None])]
    kind = "string" if not values or isinstance(values[0], str) else "int"
    table = w.places.sparkSession.createDataFrame([(a, c, v, i) for i, (a, c, v) in enumerate(cells)], f"anchor_category string, category string, {extra or '__none'} {kind}, stratum int")
    order = [draw_order(w.seed, "poi_id"), "poi_id"]
    scratch = w.scratch()

    def candidates(depth: int) -> DataFrame:
        ranked = w.named().where(F.col("category").isin(w.categories)).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("place") <= depth)
        drawn = ranked.select(F.col("poi_id").alias("anchor_index"), F.col("poi_name").alias("anchor_name"), F.col("category").alias("anchor_category"), F.col("x").alias("anchor_x"), F.col("y").alias("anchor_y"), "place")
        # as many rows as pairs of categories
        rows = drawn.join(F.broadcast(table), "anchor_category").withColumn("same_cat", F.col("anchor_category") == F.col("category"))
        ids = F.md5(F.concat_ws("|", "anchor_index", "category", *([extra] if extra else [])))
        return rows.withColumn("question_id", ids) if extra else rows.drop("__none").withColumn("question_id", ids)

    strata = [(i, float((ratio or {}).get((a, c), 0.0 if ratio else 1.0))) for i, (a, c, _) in enumerate(cells)]
    return first_answered(scratch, strata, nb_q, candidates, answer, ["question_id"])


def _positions(asked: DataFrame) -> DataFrame:
    return asked.withColumns({"x": F.col("anchor_x"), "y": F.col("anchor_y")})


def point_near(w: World, nb_q: int = 110, ratio: dict | None = None) -> DataFrame:
    asked, found = _anchored(w, nb_q, ratio, lambda rows: R.near(_positions(rows), w.index))
    return pack(asked, found, ["question_id"], w.places, "point_near", F.concat("category", F.lit(" near "), "anchor_name"))


def point_near_metric(w: World, nb_q: int = 110, ratio: dict | None = None, distances: list[int] | None = None) -> DataFrame:
    asked, found = _anchored(w, nb_q, ratio, lambda rows: R.near_metric(_positions(rows), w.places), "distance", distances or DISTANCES)
    text = F.concat("category", F.lit(" at less than "), F.col("distance").cast("string"), F.lit(" meters from "), "anchor_name")
    return pack(asked, found, ["question_id"], w.places, "point_near_metric", text)


def _check_directions(directions: list[str]) -> None:
    wrong = [d for d in directions if d not in DIRECTIONS]
    if wrong:
        raise ValueError(f"directions must be among {DIRECTIONS}, not {wrong}")


def point_near_cardinal(w: World, nb_q: int = 110, ratio: dict | None = None, directions: list[str] | None = None, half_width: float = R.HALF_WIDTH) -> DataFrame:
    directions = directions or DIRECTIONS
    _check_directions(directions)
    asked, found = _anchored(w, nb_q, ratio, lambda rows: R.near_cardinal(_positions(rows), w.index, half_width=half_width), "direction", directions)
    text = F.concat("category", F.lit(" to the "), "direction", F.lit(" of "), "anchor_name")
    return pack(asked, found, ["question_id"], w.places, "point_near_cardinal", text)


def _reachable(asked: DataFrame, places: DataFrame, reach: float, exclude: list[str]) -> DataFrame:
    """asked (x, y) with every place of any category within reach, as b_*."""
    every = places.withColumn("category", F.lit("*"))
    asked = asked.withColumnRenamed("category", "__asked").withColumn("category", F.lit("*"))
    met = radius_join(asked, every, F.lit(reach)).where(R.not_anchor(*exclude))
    met = met.join(places.select("poi_id", F.col("poi_name").alias("point_b_name"), F.col("category").alias("point_b_category")), "poi_id")
    return met.drop("category", "reach", "gap").withColumnsRenamed({"__asked": "category", "poi_id": "point_b_index", "px": "point_b_x", "py": "point_b_y"})


B = ("index", "name", "category", "x", "y")


def point_towards(w: World, nb_q: int = 110, ratio: dict | None = None, half_width: float = R.HALF_WIDTH, reach: float = 1000.0) -> DataFrame:
    """Every anchor has one B for a category, drawn among the named places within reach."""

    def with_b(rows: DataFrame) -> DataFrame:
        met = _reachable(_positions(rows), w.named(), reach, ["anchor_index"])
        return per_group(met, ["question_id"], [draw_order(w.seed, "question_id", "point_b_index"), "point_b_index"], 1)

    def answer(rows: DataFrame) -> DataFrame:
        rows = with_b(rows)
        found = R.towards(rows.withColumns({"bx": F.col("point_b_x"), "by": F.col("point_b_y")}), w.index, half_width=half_width)
        return found.join(rows.select("question_id", *[f"point_b_{c}" for c in B]), "question_id")

    asked, found = _anchored(w, nb_q, ratio, answer)
    asked = asked.join(found.select("question_id", *[f"point_b_{c}" for c in B]).distinct(), "question_id")
    text = F.concat("category", F.lit(" near "), "anchor_name", F.lit(" towards "), "point_b_name")
    return pack(asked, found, ["question_id"], w.places, "point_towards", text)


def point_between(w: World, nb_q: int = 110, ratio: dict | None = None, corridor: float = R.CORRIDOR, reach: float = 1000.0, mirror: float = 400.0) -> DataFrame:
    """A target of the category, A near it, B near A's mirror image behind the target."""
    places, scratch = w.named(), w.scratch()
    number = F.create_map(*[F.lit(v) for i, c in enumerate(w.categories) for v in (c, i)])
    ends = [f"anchor_{s}_{c}" for s in "ab" for c in B]

    def candidates(depth: int) -> DataFrame:
        targets = places.where(F.col("category").isin(w.categories)).withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(draw_order(w.seed, "poi_id"), "poi_id")))
        return targets.where(F.col("place") <= depth).select(F.col("poi_id").alias("target"), "category", "x", "y", "place", number[F.col("category")].alias("stratum"))

    def answer(rows: DataFrame) -> DataFrame:
        rows = rows.select("target", "category", "x", "y", F.col("x").alias("tx"), F.col("y").alias("ty"))
        first = per_group(_reachable(rows, places, reach, ["target"]), ["target"], [draw_order(w.seed, "target", "point_b_index"), "point_b_index"], 1)
        first = first.withColumnsRenamed({f"point_b_{c}": f"anchor_a_{c}" for c in B})
        second = first.withColumns({"x": 2 * F.col("tx") - F.col("anchor_a_x"), "y": 2 * F.col("ty") - F.col("anchor_a_y")})
        second = per_group(_reachable(second, places, mirror, ["target", "anchor_a_index"]), ["target"], [draw_order(w.seed, "target", "point_b_index"), "point_b_index"], 1)
        both = scratch.cut(second.withColumnsRenamed({f"point_b_{c}": f"anchor_b_{c}" for c in B}).select("target", "category", *ends), f"ends{Scratch.fresh()}")
        position = {"question_id": F.col("target"), "x": F.col("anchor_a_x"), "y": F.col("anchor_a_y"), "bx": F.col("anchor_b_x"), "by": F.col("anchor_b_y"), "anchor_index": F.col("anchor_a_index"), "point_b_index": F.col("anchor_b_index")}
        found = R.between(both.select("target", "category", *ends).withColumns(position), w.places, corridor=corridor)
        return found.drop("along").withColumnRenamed("question_id", "target").join(both.drop("category"), "target")

    asked, found = first_answered(scratch, w.by_category(ratio), nb_q, candidates, answer, ["target"])
    asked = asked.select("target", "category").join(found.select("target", *ends).distinct(), "target")
    asked = asked.withColumn("question_id", F.md5(F.concat_ws("|", "target", "anchor_a_index", "anchor_b_index")))
    asked = asked.withColumn("same_cat", (F.col("anchor_a_category") == F.col("category")) | (F.col("anchor_b_category") == F.col("category")))
    text = F.concat("category", F.lit(" between "), "anchor_a_name", F.lit(" and "), "anchor_b_name")
    return pack(asked, found, ["target"], w.places, "point_between", text).drop("target")


def _named_areas(w: World, min_size: float) -> DataFrame:
    return w.areas.where("area_name IS NOT NULL").where(F.col("size") > min_size)


def _about_areas(w: World, nb_q: int, min_size: float, answer: Callable[[DataFrame], DataFrame], function: str, text: Column, directions: list[str] | None = None) -> DataFrame:
    """Questions about areas: strata are the categories, candidates the areas, with each direction if there are any."""
    keys, order = [*R.AREA_KEYS, *(["direction"] if directions else [])], ["area_id", *(["direction"] if directions else [])]
    rows = _named_areas(w, min_size).select("area_id")
    if directions:
        rows = rows.withColumn("direction", F.explode(F.array(*map(F.lit, directions))))
    asked, found = first_answered(w.scratch(), w.by_category(), nb_q, lambda depth: w.for_each_category(w.first(rows, order, depth)), answer, keys)
    asked = asked.join(w.areas.select("area_id", "area_name", F.col("rings").alias("area_geometry")), "area_id")
    return pack(asked, found, keys, w.places, function, text).withColumnRenamed("area_id", "area_index")


def area_inside(w: World, nb_q: int = 110, min_size: float = 1000.0) -> DataFrame:
    return _about_areas(w, nb_q, min_size, lambda rows: R.inside(rows, w.areas, w.places), "area_inside", F.concat("category", F.lit(" inside "), "area_name"))


def area_outside(w: World, nb_q: int = 110, min_size: float = 1000.0, k: int = R.K) -> DataFrame:
    return _about_areas(w, nb_q, min_size, lambda rows: R.outside(rows, w.areas, w.index, k), "area_outside", F.concat("category", F.lit(" outside "), "area_name"))


def area_border(w: World, nb_q: int = 110, min_size: float = 1000.0, k: int = R.K, solid: bool = False) -> DataFrame:
    return _about_areas(w, nb_q, min_size, lambda rows: R.border(rows, w.areas, w.index, k, solid), "area_border", F.concat("category", F.lit(" at the border of "), "area_name"))


def area_direction(w: World, nb_q: int = 110, min_size: float = 1000.0, directions: list[str] | None = None) -> DataFrame:
    directions = directions or DIRECTIONS
    _check_directions(directions)
    text = F.concat("category", F.lit(" at the "), "direction", F.lit(" of "), "area_name")
    return _about_areas(w, nb_q, min_size, lambda rows: R.direction_in(rows, w.areas, w.places), "area_direction", text, directions)


def _about_street(w: World, asked: DataFrame, key: str, prefix: str) -> DataFrame:
    about = w.streets.select(F.col("id_street").alias(key), F.col("street_name").alias(f"{prefix}_name"), F.col("parts").alias(f"{prefix}_geometry"))
    return asked.join(about, key)


def street_along(w: World, nb_q: int = 110, min_length: float = 500.0, k: int = R.K) -> DataFrame:
    long = w.streets.where(F.col("street_name").isNotNull() & (F.col("length") > min_length)).select("id_street")
    keys = ["id_street", "category"]
    asked, found = first_answered(w.scratch(), w.by_category(), nb_q, lambda depth: w.for_each_category(w.first(long, ["id_street"], depth)), lambda rows: R.along(rows, w.streets, w.index, k), keys)
    rows = pack(_about_street(w, asked, "id_street", "street"), found, keys, w.places, "street_along", F.concat("category", F.lit(" following "), "street_name"))
    return rows.withColumnRenamed("id_street", "street_index")


def street_cross(w: World, nb_q: int = 110, k: int = R.K) -> DataFrame:
    """Pairs of named streets that really cross, asked both ways."""
    scratch = w.scratch()
    points = scratch.cut(R.crossings(w.streets.where("street_name IS NOT NULL")), "points")
    pairs = points.select("street_a", "street_b").distinct()
    pairs = pairs.unionByName(pairs.select(F.col("street_b").alias("street_a"), F.col("street_a").alias("street_b")))
    keys = ["street_a", "street_b", "category"]

    def answer(rows: DataFrame) -> DataFrame:
        low = rows.select(F.least("street_a", "street_b").alias("low"), F.greatest("street_a", "street_b").alias("high"), *keys)
        found = R.cross(low.select(F.col("low").alias("street_a"), F.col("high").alias("street_b"), "category"), points, w.index, k)
        return found.withColumnsRenamed({"street_a": "low", "street_b": "high"}).join(low, ["low", "high", "category"]).drop("low", "high")

    asked, found = first_answered(scratch, w.by_category(), nb_q, lambda depth: w.for_each_category(w.first(pairs, ["street_a", "street_b"], depth)), answer, keys)
    about = _about_street(w, _about_street(w, asked, "street_a", "street_a"), "street_b", "street_b")
    text = F.concat("category", F.lit(" at the intersection of  "), "street_a_name", F.lit(" and "), "street_b_name")
    rows = pack(about, found, keys, w.places, "street_cross", text)
    return rows.withColumnsRenamed({"street_a": "street_a_index", "street_b": "street_b_index"})


def street_opposite_side(w: World, nb_q: int = 110, k: int = R.K, reach: float = 40.0) -> DataFrame:
    scratch = w.scratch()
    named = w.streets.where("street_name IS NOT NULL")
    close = scratch.cut(R.along_street_pairs(named, w.named(), reach).select("id_street", F.col("poi_id").alias("poi_y")).distinct(), "close")
    keys = ["id_street", "poi_y", "category"]
    asked, found = first_answered(scratch, w.by_category(), nb_q, lambda depth: w.for_each_category(w.first(close, ["id_street", "poi_y"], depth)), lambda rows: R.opposite_side(rows, named, w.places, k), keys)
    y = w.places.select(F.col("poi_id").alias("poi_y"), F.col("poi_name").alias("poi_y_name"), F.col("x").alias("poi_y_x"), F.col("y").alias("poi_y_y"))
    about = _about_street(w, asked, "id_street", "street").join(y, "poi_y")
    text = F.concat("category", F.lit(" across "), "street_name", F.lit(" from "), "poi_y_name")
    rows = pack(about, found.drop("score"), keys, w.places, "street_opposite_side", text)
    return rows.withColumnsRenamed({"id_street": "street_index", "poi_y": "poi_y_id"})


def shortfall(rows: DataFrame, nb_q: int, names: list[str] | None = None) -> DataFrame:
    """(function, asked, produced, missing) of each template."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(n,) for n in names or TEMPLATES], "function string")
    got = rows.groupBy("function").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return every.join(got, "function", "left").select("function", F.lit(nb_q).alias("asked"), n.alias("produced"), (F.lit(nb_q) - n).alias("missing"))


@dataclass(frozen=True)
class Template:
    """A generator with what it needs, its context columns, and the column its query mentions."""

    name: str
    generate: Callable[..., DataFrame]
    needs: tuple[str, ...]
    context: tuple[str, ...]
    label: str
    dist_is_ranking_key: bool = True


_ANCHOR = ("anchor_index", "anchor_name", "anchor_category", "anchor_x", "anchor_y", "same_cat")
_B = ("point_b_index", "point_b_name", "point_b_category", "point_b_x", "point_b_y")
_AB = tuple(f"anchor_{s}_{c}" for s in "ab" for c in ("index", "name", "category", "x", "y"))
_AREA = ("area_index", "area_name", "area_geometry")
_STREET = ("street_index", "street_name", "street_geometry")

TEMPLATES: dict[str, Template] = {}


def template(name: str, needs: tuple[str, ...], context: tuple[str, ...], label: str, dist_is_ranking_key: bool = True):
    """Registers a generator; own templates are added the same way."""

    def add(generate: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        TEMPLATES[name] = Template(name, generate, needs, context, label, dist_is_ranking_key)
        return generate

    return add


for _f, _needs, _context, _label in [
    (point_near, (), _ANCHOR, "anchor_name"),
    (point_near_metric, (), (*_ANCHOR, "distance"), "anchor_name"),
    (point_near_cardinal, (), (*_ANCHOR, "direction"), "anchor_name"),
    (point_towards, (), (*_ANCHOR, *_B), "anchor_name"),
    (point_between, (), (*_AB, "same_cat"), "anchor_a_name"),
    (area_inside, ("areas",), _AREA, "area_name"),
    (area_outside, ("areas",), _AREA, "area_name"),
    (area_border, ("areas",), _AREA, "area_name"),
    (area_direction, ("areas",), (*_AREA, "direction"), "area_name"),
    (street_along, ("streets",), _STREET, "street_name"),
    (street_cross, ("streets",), tuple(f"street_{s}_{c}" for s in "ab" for c in ("index", "name", "geometry")), "street_a_name"),
    (street_opposite_side, ("streets",), (*_STREET, "poi_y_id", "poi_y_name", "poi_y_x", "poi_y_y"), "street_name"),
]:
    template(_f.__name__, _needs, _context, _label, _f is not street_opposite_side)(_f)


def all_templates(w: World, nb_q: int = 100, names: list[str] | None = None) -> DataFrame:
    """The union of the templates' questions, columns that one lacks as null, with a question_id for all."""
    made = [t for t in (TEMPLATES[n] for n in names or TEMPLATES) if all(getattr(w, n) is not None for n in t.needs)]
    # each is written, as drawing the questions is much work, and one plan of all would be too large for the driver
    scratch = w.scratch()
    parts = [scratch.cut(t.generate(w, nb_q).drop("question_id"), t.name) for t in made]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    ids = F.md5(F.concat_ws("|", "function", "query", F.array_join(F.col("results_poi_id").cast("array<string>"), ",")))
    return rows.withColumn("question_id", ids)
