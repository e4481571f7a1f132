"""Names here are of words that occur in none of the test tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from kinmark.llm import variants
from kinmark.plans.storage import Scratch

COLUMNS = "row_id long, string string, count long, `group` string, feed string, core string, n long"
CORES = ["Quelbrant Ostwyck", "Harnwick Delphora", "Umbrast Xanquil", "Cyrreth Wolmandy", "Brixholt Eskendar", "Thornquay Ambleth", "Yarrowick Pendrell", "Glimshaw Corvenant", "Fennimoor Hrastka", "Wexcombe Tarquiny"]


def linked(spark, groups, typed):
    """The labels of typed names; groups are lists of forms, the first the label."""
    rows = [(i, s, 1, None, "x", "?", 0) for i, s in enumerate(typed)]
    rows += [(1000 + 50 * g + i, s, 1, forms[0], "x", "?", 0) for g, forms in enumerate(groups) for i, s in enumerate(forms)]
    got = {r["row_id"]: r["group"] for r in variants.link_variants(spark.createDataFrame(rows, COLUMNS)).collect()}
    return [got.get(i) for i in range(len(typed))]


def test_words_are_learned_from_groups(spark):
    groups = []
    for i, c in enumerate(CORES):
        groups.append([f"{c} Brewery Zrt", f"{c} Brwy Zrt", f"{c} Brewery", f"{c} Brewery Zrt."])
        groups.append([f"{c} Orchestra Zrt", f"{c} Orch Zrt", f"{c} Orchestra"])
        first, rest = ("Evangeline", "Vangie") if i % 2 else ("Cuthbert", "Cuddy")
        groups.append([f"{first} {c}", f"{rest} {c}", f"{first[0]}. {c}", f"Rev {first} {c}"])
    c = CORES
    typed = [f"{c[0]} brwy", f"zrt orchestra {c[1].upper()}", f"{c[2]} Zrt", f"Vangie {c[3]}", f"{c[4]}, C.", f"Cuddy {c[5]}", f"rev evangeline x. {c[7]}", f"Quelbrnat Ostwikc Orch", f"{c[6].replace(' ', '')} Brewery"]
    want = [groups[0][0], groups[4][0], None, groups[11][0], groups[14][0], None, groups[23][0], groups[1][0], groups[18][0]]
    assert linked(spark, groups, typed) == want


def test_names_of_a_table_that_teaches_nothing(spark):
    groups = [["Pobelta Rekuntis Brewery Corp"], ["Northern Bakery Kolumet GmbH"], ["Robert Ashdale Munkvik"], ["Ünverg Ltd"], ["Inc"]]
    typed = ["Pobelta Rekuntis Bakery Corp", "Pobelta Rekuntis Consulting", "Pobelta Rekuntis Brewery", "Northern Bkry Kolumet", "Bobby Ashdale Munkvik", "R. Ashdale Munkvik", "Richard Ashdale Munkvik", "unverg", None, "", "-", "Inc", "Mr", "x" * 3000]
    want = [None, None, groups[0][0], groups[1][0], groups[2][0], groups[2][0], None, None, None, None, None, None, None, None]
    got = linked(spark, groups, typed)
    assert got[:7] == want[:7] and got[8:] == want[8:]


def test_no_groups_and_no_rows(spark):
    assert linked(spark, [], ["Pobelta Brewery", "Pobelta Brewery"]) == [None, None]
    assert variants.link_variants(spark.createDataFrame([], COLUMNS)).count() == 0
    assert linked(spark, [["Ashdale Munkvik"]], []) == []


def test_a_name_in_two_groups_and_repeated_rows(spark):
    assert linked(spark, [["Ashdale Munkvik", "Ashdale Munkvik"], ["Zed", "Ashdale Munkvik"]], ["Ashdale Munkvic", "Ashdale Munkvic"]) == ["Ashdale Munkvik"] * 2


@pytest.mark.parametrize("length", [*range(4, 22)])
def test_keys_meet_within_two_slips(length):
    rng = random.Random(length)
    slips = variants.part_size(length)[0] - 1
    for _ in range(200):
        form = "".join(rng.choice("abcdefgh") for _ in range(length))
        typed = list(form)
        at = sorted(rng.sample(range(length), slips))
        for k, i in enumerate(reversed(at)):
            what = rng.choice("idrs")
            if what == "i":
                typed.insert(i, "z")
            elif what == "d":
                del typed[i]
            elif what == "s" and i + 1 < len(typed) and (k == 0 or i + 2 < at[len(at) - k]):
                typed[i : i + 2] = typed[i + 1], typed[i]
            else:
                typed[i] = "y"
        probe, held = variants.probe_keys(["".join(typed)])[0].as_py(), variants.held_keys([form])[0].as_py()
        assert set(probe) & set(held), (form, "".join(typed))


def test_sketches_and_cosines():
    a, b = variants.sketch(["pobelta rekuntis", "rekuntis pobelta"]).to_pylist()
    assert a == b and variants.sketch(["", "a", "aa", "a a a"]).to_pylist() == [0, 2, 2 + (2 << 32), 2 + (2 << 32)]
    weights = variants.Weights(np.array([], np.uint64), np.array([]), 1.0)
    got = variants.cosines(["abcd", "abcd", "ab", "日本語"], ["abcd", "abce", "cd", "日本語"], weights)
    assert np.allclose(got, [1, 0.5, 0, 1])


def brute_linkage(n, sims, least):
    clusters = [{i} for i in range(n)]
    while True:
        best = max(((sum(sims.get((min(x, y), max(x, y)), 0) for x in a for y in b) / (len(a) * len(b)), -i, -j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j), default=(0, 0, 0))
        if best[0] < least:
            return {frozenset(c) for c in clusters if len(c) > 1}
        i, j = -best[1], -best[2]
        clusters[i] |= clusters.pop(j)


@pytest.mark.parametrize("seed", [1, 2])
def test_average_linkage_is_that_of_one_union_after_the_other(spark, seed):
    rng = random.Random(seed)
    sims = {(i, j): rng.uniform(0.5, 1) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.75}
    df = spark.createDataFrame([(i, j, s) for (i, j), s in sims.items()], "a long, b long, s double")
    got: dict[int, set[int]] = {}
    for r in variants.average_linkage(df, Scratch(spark)).collect():
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(c) for c in got.values()} == brute_linkage(14, sims, variants.CLUSTER)


def test_parse_is_by_row():
    known = variants.Vocabulary({"brwy": "brewery", "bob": "robert"}, frozenset({"zrt"}), frozenset({"brewery"}), frozenset({"robert"}))
    got = variants.parse(pa.array(["a brwy pobelta zrt", "bob c munkvik", "q munkvik", "zrt", "x y", "robert brewery"]), known).to_pylist()
    p = lambda *x: dict(zip(("kind", "given", "core"), x, strict=True))
    assert got == [p("brewery", "", "pobelta"), p("~r", "robert", "munkvik"), p("~q", "", "munkvik"), None, p("~x", "", "x y"), p("brewery", "", "robert")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (x != y))
    return row[-1]


def passing(a, b):
    """Whether two cores are within the edits allowed, or have the same letters but two."""
    x, y = a.split(" "), b.split(" ")
    runs = [("".join(p), "".join(q)) for p, q in ((x, y), (x, y[::-1]), (x[::-1], y), (sorted(x), sorted(y)))]
    longer = max(len(p) for p in runs[0])
    least = min(distance(p, q) for p, q in runs)
    return least <= 2 or least / longer <= variants.MAX_EDITS, least <= longer / 2 + 1 and distance(sorted(runs[0][0]), sorted(runs[0][1])) <= 2


def alike(a, b):
    """Whether a pair that passes does so word for word as well, where both have as many words."""
    x, y = a.split(" "), b.split(" ")
    one = lambda p, q: distance(p, q) <= max(len(p), len(q)) / 4 + 1 or passing(p, q)[1]
    orders = ((x, y), (x, y[::-1]), (x[::-1], y), (sorted(x), sorted(y)))
    return len(x) != len(y) or any("".join(p) == "".join(q) or all(map(one, p, q)) for p, q in orders)


def variant_cores(seed, words, letters, n):
    rng = random.Random(seed)
    cores = []
    for _ in range(n):
        form = ["".join(rng.choice("abcdeéж日") for _ in range(max(1, letters + rng.randrange(-2, 3)))) for _ in range(words)]
        cores.append(" ".join(form))
        typed = list(cores[-1])
        for _ in range(rng.randrange(variants.most_edits(letters * words) + 3)):
            typed = typed or ["a"]
            i = rng.randrange(len(typed))
            typed[i : i + 1] = rng.choice([[], [rng.choice("abxy")], [typed[i], "z"], ["q"]])
        again = "".join(typed).split() or ["a"]
        rng.shuffle(again)
        cores.append(" ".join(again))
    return cores


@pytest.mark.parametrize("words,letters", [(1, 2), (1, 6), (2, 5), (2, 9), (3, 6), (4, 15), (3, 25)])
def test_no_pair_within_the_edits_is_left_out(words, letters):
    cores = variant_cores(words, words, letters, 25)
    places = np.arange(len(cores))
    got = [(a, b) for q, f in variants.close_pairs(cores, places, places) for a, b in zip(q.tolist(), f.tolist(), strict=True)]
    assert len(got) == len(set(got))
    want = {(i, j) for i in places.tolist() for j in places.tolist() if any(passing(cores[i], cores[j])) and alike(cores[i], cores[j])}
    assert len(want) > len(cores) and want <= set(got)


def test_no_edits_are_counted_twice(monkeypatch):
    cores = list(dict.fromkeys(variant_cores(8, 1, 12, 25) + variant_cores(9, 2, 6, 25)))
    counted, edits = [], variants.Runs.edits

    def count(self, a, n, other, b, m):
        side = lambda runs, i, size: "".join(chr(x) for x in runs.letters[:size, i])
        counted.extend((x, side(self, x, n), y, side(other, y, m)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        return edits(self, a, n, other, b, m)

    monkeypatch.setattr(variants.Runs, "edits", count)
    places = np.arange(len(cores))
    assert sum(len(q) for q, _ in variants.close_pairs(cores, places, places)) > len(cores)
    assert len(counted) == len(set(counted)) > len(cores)


def test_rows_of_one_core_meet_all_of_another(monkeypatch):
    monkeypatch.setattr(variants, "AT_ONCE", 4)
    code = np.array([1, 0, 1, 2, 1, 0])
    asked, others = (variants.Copies.of(np.array(rows), code, 3) for rows in ([0, 2, 3], [1, 3, 4, 5]))
    got = [p for q, f in asked.products(np.array([1, 2, 1]), others, np.array([0, 2, 1])) for p in zip(q.tolist(), f.tolist(), strict=True)]
    assert got == [(0, 1), (0, 5), (2, 1), (2, 5), (3, 3), (0, 4), (2, 4)]
    assert not [*asked.products(code[:0], others, code[:0])]


def test_near_pairs_are_those_of_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 7)
    cores = variant_cores(5, 1, 12, 5) + variant_cores(6, 2, 6, 10) + variant_cores(7, 3, 4, 5)
    rows = [(i, None if i % 2 else i, f"k{i // 2 % 2}", "", c, 1) for i, c in enumerate(cores)]
    points = spark.createDataFrame(rows, "id long, gid long, kind string, given string, core string, n long")
    got = sorted((r["q"], r["f"]) for r in variants.near_pairs(points, variants.gram_weights(points), Scratch(spark)).collect())
    assert got == [(q, f) for q in range(1, 40, 2) for f in range(40) if q != f and rows[q][2] == rows[f][2] and any(passing(cores[q], cores[f])) and alike(cores[q], cores[f])]


def test_slips_in_every_part_of_a_name(spark):
    groups = [["Quelbrant Ostwyckmor"], ["Harnwick Delphoramund"]]
    assert linked(spark, groups, ["Quxlbrant Oxtwyckxor", "Delxhoramxnd Hxrnwick", "Quxlbxant Xstwxckxor"]) == [groups[0][0], groups[1][0], groups[0][0]]
