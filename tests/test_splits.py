import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from motorgrid.operators import splits
from motorgrid.operators.skew import class_positions, hash_bucket, running_total
from motorgrid.plans import labelling

CELLS = [("Toyota", "Camry", 2012, "front"), ("Kia", "Rio", None, "rear"), ("Kia", "Rio", 2008, "side")]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    # The first cell holds most rows; one of its listings holds a third of them.
    for cell, listings in zip(CELLS, (300, 30, 3)):
        for n in range(listings):
            size = 150 if (listings == 300 and n == 0) else rng.randint(1, 3)
            data += [(f"{cell[1]}-{cell[3]}-{n}-{i}", f"l{n}", *cell) for i in range(size)]
    return spark.createDataFrame(
        data, "image_id string, listing_id string, canonical_make string, canonical_model string, "
        "generation_year int, view string").cache()


def _walk(cell_rows, order, train=0.8, val=0.1):
    """Plain restatement of the rule."""
    if len(cell_rows) < 10:
        return {image: "train" for image, _ in cell_rows}
    by_listing = defaultdict(list)
    for image, listing in cell_rows:
        by_listing[listing].append(image)
    goal_train, goal_val = round(train * len(cell_rows)), round(val * len(cell_rows))
    n_train = n_val = 0
    out = {}
    for listing in sorted(by_listing, key=lambda x: (order[x], x)):
        if n_train < goal_train:
            split, n_train = "train", n_train + len(by_listing[listing])
        elif n_val < goal_val:
            split, n_val = "val", n_val + len(by_listing[listing])
        else:
            split = "test"
        out.update(dict.fromkeys(by_listing[listing], split))
    return out


def test_listing_split_follows_the_walk(rows):
    order = {r.listing_id: r.h for r in rows.select(
        "listing_id", splits.shuffle_key(42, "listing_id").alias("h")).distinct().collect()}
    cells = defaultdict(list)
    for r in rows.collect():
        cells[(r.canonical_make, r.canonical_model, r.generation_year, r.view)].append(
            (r.image_id, r.listing_id))
    expected = {}
    for cell_rows in cells.values():
        expected.update(_walk(cell_rows, order))
    got = {r.image_id: r.split for r in splits.assign_by_listing(rows).collect()}
    assert got == expected


def test_no_listing_in_two_splits_of_a_cell(rows):
    joined = splits.assign_by_listing(rows).join(rows.select("image_id", "listing_id"), "image_id")
    worst = joined.groupBy(*splits.CELL, "listing_id").agg(F.countDistinct("split").alias("n"))
    assert worst.where("n > 1").count() == 0


def test_image_split_targets_and_seed(rows):
    first = {r.image_id: r.split for r in splits.assign_by_image(rows, seed=1).collect()}
    again = {r.image_id: r.split for r in splits.assign_by_image(rows.repartition(5), seed=1).collect()}
    other = {r.image_id: r.split for r in splits.assign_by_image(rows, seed=2).collect()}
    assert first == again and first != other
    big = [s for i, s in first.items() if i.startswith("Camry")]
    n = len(big)
    assert big.count("train") == round(0.8 * n) and big.count("val") == round(0.1 * n)


def test_running_total_is_exact(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("g"), "id",
        F.sha1(F.col("id").cast("string")).alias("h"))
    out = running_total(df, ["g"], ["h"], hash_bucket(F.col("h")), F.col("id"), "before", "total")
    groups = defaultdict(list)
    for r in out.collect():
        groups[r.g].append(r)
    for members in groups.values():
        seen = 0
        for r in sorted(members, key=lambda r: r.h):
            assert r.before == seen
            seen += r.id
        assert {r.total for r in members} == {seen}


def test_running_total_keeps_null_buckets(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", None, 3), ("b", None, 4)],
                               "g string, o int, n int")
    out = running_total(df, ["g"], ["o", "n"], F.col("o"), F.lit(1), "before")
    assert {r.n: r.before for r in out.collect()} == {1: 0, 3: 1, 2: 2, 4: 0}


def test_class_positions(spark):
    names = [f"{y}|make{m}|x" for y in (1999, 2000, 2012) for m in range(40)]
    got = class_positions(spark.createDataFrame([(n,) for n in names], "c string"), "c", "i").collect()
    assert {r.c: r.i for r in got} == {n: i for i, n in enumerate(sorted(names))}


def test_argument_checks():
    for bad in ((0.9, 0.2, 10), (-0.1, 0.5, 10), (0.0, 0.0, 10), (0.8, 0.1, 0)):
        with pytest.raises(ValueError):
            labelling.check_fractions(*bad)


def test_make_splits_keeps_and_rebuilds(spark, rows):
    listings = rows.select("listing_id", "canonical_make", "canonical_model", "generation_year").where(
        "canonical_make = 'Toyota'").distinct().withColumn("source", F.lit("s"))
    images = rows.where("canonical_make = 'Toyota'").select(
        "image_id", "listing_id", "view",
        F.when(F.col("listing_id") == "l0", "held").alias("split"))
    kept = labelling.make_splits(images, listings, "s")["images"]
    assert kept.where("listing_id = 'l0'").select("split").distinct().collect()[0].split == "held"
    rebuilt = labelling.make_splits(images, listings, "s", rebuild=True)["images"]
    assert rebuilt.where("split = 'held' or split is null").count() == 0
