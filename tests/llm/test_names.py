from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kinmark.llm import copies, lookalike, queries, splits, survivor
from kinmark.llm.linked import linked_strings

DAY = dt.datetime(2024, 1, 1)
ROWS = "row_id long, string string, count long, `group` string, feed string, seen_at timestamp_ntz, plain string, rank int"


def matcher(spark, rows):
    """Rows (id, string, count, group, feed, day), with two more columns whose names the operators use inside."""
    return spark.createDataFrame([(i, s, n, g, f, DAY + dt.timedelta(days=d), "?", 0) for i, s, n, g, f, d in rows], ROWS)


def test_survivor_follows_the_statement(spark):
    rows = [
        (1, "A", 5, "g", "x", 0), (2, "A", 5, "g", "x", 0), (3, "B", 6, "g", "y", 1), (4, "B", None, "g", "x", 9), (5, "b", None, "g", "x", 2), (6, "T2", 1, "h", "x", 0), (7, "T1", None, "h", "y", 0),
        (8, "only", 3, "one", "x", 0), (9, None, 9, "one", "x", 0), (10, "A", 3, None, "x", 0), (11, "", 2, "k", "x", 3), (12, "K", 1, "k", None, 3), (13, "", 2, "k", "y", 3),
    ]
    got = {r["group"]: r["row_id"] for r in survivor.best_representatives(matcher(spark, rows)).collect()}
    assert got == {"g": 3, "h": 7, "k": 11}
    assert survivor.best_representatives(matcher(spark, [])).count() == 0
    assert {r["string"] for r in survivor.judged_values(matcher(spark, rows)).where("`group` = 'g'").collect()} >= {"B"}
    assert survivor.source_quality(matcher(spark, [])).count() == 0


def test_em_tells_good_sources_from_bad(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for g in range(150):
        for feed, right in (("good", 0.95), ("fair", 0.8), ("bad", 0.2)):
            i += 1
            rows.append((i, f"true {g}" if rng.random() < right else f"false {g} {rng.randrange(2)}", 1, f"g{g}", feed, 0))
    q = {r["feed"]: r for r in survivor.source_quality(matcher(spark, rows)).collect()}
    assert q["good"]["sensitivity"] > q["bad"]["sensitivity"] and q["good"]["specificity"] > q["bad"]["specificity"]


def test_found_survivors_do_not_fit_a_model(spark, monkeypatch, tmp_path):
    rows = [(1, "A", 5, "g", "x", 0), (2, "A", 5, "g", "x", 0), (3, "B", 6, "g", "y", 1), (4, "T2", 1, "h", "x", 0), (5, "T1", None, "h", "y", 0), (6, "only", 3, "one", "x", 0)]
    df = matcher(spark, rows)
    df.write.parquet(f"{tmp_path}/matcher.parquet")
    want = sorted((r["group"], r["row_id"]) for r in survivor.best_representatives(df).collect())
    monkeypatch.setattr(survivor, "fit_quality", lambda patterns: 1 / 0)
    assert sorted(map(tuple, queries.p1_found(spark, str(tmp_path)).collect())) == want == [("g", 3), ("h", 5)]


def test_judged_survivors_follow_the_sources(spark):
    rows = [(3 * g + i, f"true {g}" if feed != "bad" else f"false {g}", 9 if feed == "bad" else 1, f"g{g}", feed, 0) for g in range(60) for i, feed in enumerate(("good", "fair", "bad"))]
    df = matcher(spark, rows)
    assert {r["string"] for r in survivor.survivors(df).collect()} == {f"false {g}" for g in range(60)}
    judged = survivor.judged_representatives(df).collect()
    assert {(r["group"], r["string"], r["row_id"]) for r in judged} == {(f"g{g}", f"true {g}", 3 * g) for g in range(60)}
    assert survivor.judged_representatives(matcher(spark, [])).count() == 0


FORMS = [
    ("Ｈａｌｖｏ Ｒｅｔａｉｌ", "Halvo Retail"), ("Café Ltd", "Café Ltd"), ("A​B C", "AB C"), ("Сο", "Co"), ("Pаtricia Сo", "Patricia Co"), ("ﬁne", "fine"), ("Лощeфещеж Media", "Лощефещеж Media"),
    ("ООО Тасумеме", "ООО Тасумеме"), ("Εταιρεία Κατορα", "Εταιρεία Κατορα"), ("株式会社　ジヨ", "株式会社 ジヨ"), ("CAFÉ", "CAFÉ"), ("a\tb", "a\tb"), ("", ""),
]


def test_plain_forms(spark):
    rows = matcher(spark, [(i, s, 1, None, "x", 0) for i, (s, _) in enumerate([*FORMS, (None, None)])])
    got = {r["row_id"]: r["plain"] for r in lookalike.ordinary_forms(rows).collect()}
    assert got == {i: p for i, (s, p) in enumerate(FORMS) if s != p}
    assert all(lookalike.plain(p) == p for _, p in FORMS)
    assert lookalike.ordinary_forms(matcher(spark, [])).count() == 0
    both = lookalike.lookalike_groups(matcher(spark, [(1, "Co", 1, None, "x", 0), (2, "Сο", 1, None, "x", 0), (3, "Co", 1, None, "x", 0), (4, None, 1, None, "x", 0)])).collect()
    assert [(r["first"], r["strings"], r["rows"]) for r in both] == [("Co", 2, 3)]


STRANGE = [("Ⅼimited", "Limited"), ("ℓabs", "labs"), ("ᴀcme", "acme"), ("ꓐank", "Bank"), ("ⲟne", "one"), ("ᖇetail", "Retail"), ("ꜱtore", "store"), ("ꓐꓮꓠꓗ", "ꓐꓮꓠꓗ"), ("Straße þór", "Straße þór"), ("ニへロ", "ニへロ"), ("1º", "1º")]


def test_letters_of_other_tables(spark):
    rows = spark.createDataFrame([(i, s, 0) for i, (s, _) in enumerate(STRANGE)], "row_id long, string string, plain int")
    got = rows.select("row_id", lookalike.plain_form("string").alias("p"), lookalike.skeleton_form("string").alias("k")).collect()
    assert [r["p"] for r in sorted(got)] == [p for _, p in STRANGE]
    table = lookalike.confusables(spark)
    assert len(table) > 4000 and [r["k"] for r in sorted(got)[:7]] == [lookalike.skeleton(p, table) for _, p in STRANGE[:7]]


def test_linked_strings(spark):
    schema = "string0 string, string1 string, group0 string, group1 string, id long, rep string"
    rows = [("b", "c", "a", None), ("c", "b", None, None), ("c", "d", None, "e"), ("x", "x", None, None), ("y", None, None, None), ("", "z", None, None), ("hub", "z", None, "hub")]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], schema)
    assert {r["string"]: r["rep"] for r in linked_strings(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "": "", "z": "", "hub": ""}
    assert linked_strings(df.where("false")).count() == 0
    chain = [(f"n{i:03d}", f"n{i + 1:03d}", None, None, 0, "") for i in range(120)] + [("n000", f"h{i}", None, None, 0, "") for i in range(40)]
    found = linked_strings(spark.createDataFrame(chain, schema)).collect()
    assert len(found) == 161 and {r["rep"] for r in found} == {"h0"}


SAME = [(1, "A.B. Foods, Co", 1), (2, "co foods ab", None), (3, "CO; FOODS; AB", 2), (4, "ab foods co co", 1), (5, "--", 1), (6, "--", 1), (7, None, 1), (8, "", 1), (9, "x " * 300, 1), (10, "x " * 300, 3)]


def test_copies(spark):
    df = matcher(spark, [(i, s, n, None, "x", 0) for i, s, n in SAME])
    assert sorted(map(tuple, copies.copies_found(df).collect())) == [(1, 2), (1, 3), (9, 10)]
    assert {(r["keep_id"], r["copies"], r["total"]) for r in copies.collapsed(df).collect()} == {(1, 3, 4), (4, 1, 1), (9, 2, 4)}
    assert copies.copies_found(df.where("false")).count() == 0


def test_records_of_several_fields(spark):
    rows = [(1, "A.B. Foods", None, "x y", "web", 0), (2, "foods, AB", 4, "X-Y", "Web", 0), (3, "x y", 1, "foods ab", "web", 0), (4, None, 1, "--", "web", 0), (5, "", 1, None, "web!", 0), (6, None, 1, None, "", 0)]
    df = matcher(spark, rows)
    got = {(r["keep_id"], r["copies"], r["total"], len(r["fields"])) for r in copies.collapsed_records(df, ["feed", "string", "group"]).collect()}
    assert got == {(1, 1, 1, 3), (2, 1, 4, 3), (3, 1, 1, 3), (4, 2, 2, 1)}
    assert copies.collapsed_records(df.where("false"), ["string"]).count() == 0
    same = copies.collapsed_records(spark.createDataFrame([(1, "A  b", 1, "C"), (2, "a B.", None, "c ")], "row_id long, s string, count long, t string"), ["t", "s"]).collect()
    assert [(r["keep_id"], r["copies"], r["total"]) for r in same] == [(1, 2, 2)]


def test_copies_are_compared_and_not_their_hashes_alone(spark, monkeypatch):
    df = matcher(spark, [(1, "a b", 1, "x", "f", 0), (2, "b A.", 1, "X", "f", 0), (3, "a a", 1, "x", "f", 0)])
    monkeypatch.setattr(copies, "multiset_hash", lambda words, seed: F.lit(7).cast("long"))
    assert [r["copies"] for r in copies.collapsed(df.where("row_id < 3")).collect()] == [2]
    assert [r["copies"] for r in copies.collapsed_records(df.where("row_id < 3"), ["group", "feed"]).collect()] == [2]
    for made in (lambda: copies.collapsed(df), lambda: copies.collapsed_records(df, ["string", "group"]), lambda: copies.copies_found(df)):
        with pytest.raises(Exception, match="fingerprints collide"):
            made().collect()


def test_related_labels_and_splits(spark):
    rows = [(1, "A B", 1, "g1", "x", 0), (2, "b a", 1, "g2", "x", 0), (3, "C", 1, "g2", "x", 0), (4, "c.", 1, "g3", "x", 0), (5, "b, a", 1, None, "x", 0), (6, None, 1, None, "x", 0), (7, "--", 1, "g4", "x", 0), (8, "--", 1, "g5", "x", 0)]
    rows += [(100 + i, f"name{i}", 1, f"u{i}" if i % 2 else None, "x", 0) for i in range(92)]
    df = matcher(spark, rows)
    assert sorted(map(tuple, splits.related_pairs(df).collect())) == [("g1", "g2"), ("g2", "g3")]
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1)], "split string, share double")
    got = {r["row_id"]: r["split"] for r in splits.grouped_splits(df, shares).collect()}
    assert len(got) == 100 and len({got[i] for i in (1, 2, 3, 4, 5)}) == 1
    assert sorted(list(got.values()).count(s) for s in ("train", "test", "validation")) == [10, 10, 80]
    assert splits.related_pairs(df.where("false")).count() == 0


def test_subset_sums():
    for items, target, want in (([(3, 2), (5, 1)], 8, 8), ([(4, 3)], 7, 8), ([(10, 1)], 4, 0), ([], 5, 0)):
        assert sum(s * n for s, n in splits.closest(items, target).items()) == want
