"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import __spark_entry__ as entry_points
import oracle
import pytest

SF = f"{oracle.TESTDATA}/sf0.001"
QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()
# Top makes need more test rows than the smallest tables have.
MAY_BE_EMPTY = {"make_confusions"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() > 0
        return
    found = oracle.difference(spark, duck, SF, QUERIES[name], SQL[name])
    if name in MAY_BE_EMPTY and found == "no rows at all":
        return
    assert found is None, found


def test_spaced_classes_of_a_text_in_two_languages(spark, tmp_path):
    docs = [(1, "ab", "en"), (25, "ab", "de"), (0, "ab", "en"), (6, "ab", "en"), (4, "x", "fr"), (16, "x", "es")]
    spark.createDataFrame([(i, t, lang, "src0", len(t)) for i, t, lang in docs],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).coalesce(1).write.parquet(f"{tmp_path}/written")
    (next(tmp_path.glob("written/*.parquet"))).rename(tmp_path / "documents.parquet")
    (tmp_path / "region.parquet").symlink_to(f"{SF}/region.parquet")
    assert oracle.difference(spark, oracle.connect(tmp_path), str(tmp_path), QUERIES["ingest_spaced_classes"],
                             SQL["ingest_spaced_classes"]) is None


def test_a_file_listed_twice_is_inserted_once(spark):
    from pyspark.sql import functions as F

    from motorgrid.plans import ingest

    files = spark.createDataFrame([("a/Kia_Rio/1.jpg", "Kia_Rio", ".jpg", 1, b"x")] * 2,
                                  "path string, class_dir string, ext string, length long, content binary")
    done = ingest.ingest_labelled_images(
        ingest.label_underscore(files), "vmmrdb", spark.createDataFrame([], "image_id string"), "train",
        F.lit("2020-01-01").cast("timestamp"))
    assert done["images"].count() == done["listings"].count() == 1
    assert {r.outcome: r.n for r in done["audit"].collect()} == {"inserted": 1, "existing": 1}
