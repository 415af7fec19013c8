import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("terramill-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


OSM = "poi_id long, poi_name string, category string, cooking_type string, geometry binary, lat double, lon double, x double, y double, indoor_seating string, outdoor_seating string, bow_poi string, loaded_at timestamp, deleted_at timestamp"
AREA = "area_id long, area_name string, category string, admin_level string, rings array<array<struct<x:double,y:double>>>"
STREETS = "id_street long, street_name string, parts array<array<struct<x:double,y:double>>>"
BENCHMARK = "question_id long, query string, category_query string, function string, results_poi_id array<long>, results_poi_name array<string>, results_poi_dist array<double>, results_poi_rank array<int>, anchor_index long, created_at timestamp, ingested_at timestamp"
BATCHES = "batch_id long, split string, source string, author string, questions array<array<string>>, poi_ids array<long>, created_at timestamp"
CONFIG = "config_id long, population string, sample_size int, ratio_test double, ratio_validation double, ratio_category map<string,double>, min_per_category int, seed long"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, poi_id long"
TARGETS = "mix_id long, source string, target_weight double, max_repeats int, total_tokens long"


class Tables:
    """Tables of a schema from partial rows; ``clash`` adds columns with names that operators use inside."""

    def __init__(self, spark):
        self.spark = spark

    def make(self, schema, rows=(), clash=False):
        names = [c.split()[0] for c in schema.split(", ")]
        rows = [tuple(r.get(n) for n in names) for r in rows]
        table = self.spark.createDataFrame(rows, schema)
        if clash:
            from pyspark.sql import functions as F

            for name in ("key", "id", "dist", "rank", "node", "bucket", "run", "salt", "u", "v", "root", "words", "pois", "text_", "order", "block", "n", "ids", "state", "__k", "stratum", "copies"):
                if name not in table.columns:
                    table = table.withColumn(name, F.lit("clash"))
        return table


@pytest.fixture
def tables(spark):
    return Tables(spark)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
