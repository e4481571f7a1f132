from kinmark.functions.text import ngrams, simplify, simplify_corp

SIMPLE = [
    ("Blue Heron: Sails?", "blue heron sails?"), ("QUAY; (North)", "quay north"), ("", ""), ("*;*", ""), ("7th9x", "7th9x"), ("\t Oak \n", "oak"), ("salt & pepper", "salt and pepper"), ("a&b", "a b"),
    ("x  y   z", "x y z"), ("“Nine” ‘tails’", "nine tails"), ("low_tide—high-tide", "low tide high tide"), ("O'Neil's 5<6=x", "oneils 5<6=x"), ("N.V.K. Ltd", "nvk ltd"), ("a b", "a b"), (None, None),
]
CORP = [
    ("Blue Heron Ltd.", "blue heron"), ("", ""), ("The Group", "group"), ("the Quay Holdings Co", "quay"), ("Salt Group plc SE", "salt"), ("Oak L.L.P.", "oak"), ("Oak L L C", "oak"), ("Oak l lp", "oak"), ("Inc", "inc"),
    ("Theodor Corporation", "theodor"), ("Oak Limited", "oak limited"), ("Oak Company Sails", "oak company sails"), (None, None),
]


def test_simplify(spark):
    rows = spark.createDataFrame(SIMPLE, "s string, want string").select("s", "want", simplify("s").alias("got")).collect()
    assert [(r.s, r.got) for r in rows] == SIMPLE


def test_simplify_corp(spark):
    rows = spark.createDataFrame(CORP, "s string, want string").select("s", "want", simplify_corp("s").alias("got")).collect()
    assert [(r.s, r.got) for r in rows] == CORP


def test_ngrams(spark):
    rows = spark.createDataFrame([("banana",), ("ab",), ("",), (None,)], "s string").select(ngrams("s", 3).alias("g")).collect()
    assert [r.g for r in rows] == [["ban", "ana", "nan"], ["ab"], [""], None]
