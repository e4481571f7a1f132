from __future__ import annotations

import random

import numpy as np

from kinmark.llm import boxes, mixture, neighbours, sentences


def test_neighbours_recall_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 64))
    v = np.concatenate([c + 0.25 * rng.normal(size=(12, 64)) for c in centres])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(8)]
    odd = [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] * 64), (2003, [1.0] * 63), (2004, [None] * 64)]
    got = {r["vec_id"]: r["near"] for r in neighbours.nearest_vectors(spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, v array<double>, u int")).collect()}
    assert got.keys() == {i for i, _ in rows}
    assert got[0] == [1000, 1001, 1002, 1003, 1004] and got[1000] == [0, 1001, 1002, 1003, 1004]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    cos[:, 0] = -2
    top = np.argsort(-cos, axis=1)[:, :5]
    hits = [len(set(top[i]) & set(got[i])) / 5 for i in range(12, len(v))]
    assert np.mean(hits) > 0.95
    assert neighbours.neighbour_pairs(spark.createDataFrame([], "vec_id long, v array<float>")).count() == 0


def exact_top(v, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    return np.argsort(-cos, axis=1)[:, :k]


def recall_of(spark, v):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<float>")
    got = {r["vec_id"]: r["near"] for r in neighbours.nearest_vectors(df).collect()}
    return np.mean([len(set(t) & set(got[i])) / 5 for i, t in enumerate(exact_top(v))])


def test_tables_are_added_for_vectors_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIMIT", 256)
    monkeypatch.setattr(neighbours, "TARGET", 100)
    assert recall_of(spark, np.random.default_rng(3).normal(size=(3000, 64))) >= 0.9


def test_buckets_that_cannot_be_parted_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "bucket_plan", lambda vectors, table, total: ({0: (1, None)}, {1: total, 2: total}))
    monkeypatch.setattr(neighbours, "LIMIT", 16)
    assert recall_of(spark, np.random.default_rng(4).normal(size=(90, 64))) >= 0.9


def test_parting_inside_a_task():
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(100, 1, 64)) + 0.2 * rng.normal(size=(100, 120, 64))).reshape(-1, 64)
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    ids, base = np.arange(len(u)) * 7, np.arange(len(u)) % 3 > 0
    q, n, cos = neighbours.best_in(u, ids, base, 5, 1)
    assert np.bincount(q // 7).max() == 5 and base[n // 7].all() and (q != n).all()
    s = u @ u[base].T
    s[np.flatnonzero(base), np.arange(base.sum())] = -2
    assert np.mean(cos >= -np.sort(-s, axis=1)[q // 7, 4] - 1e-6) > 0.9


def test_packing():
    rng = random.Random(3)
    for capacity in (10, 60, 512):
        for n in (1, 50, 400):
            sizes: dict[int, int] = {}
            for _ in range(n):
                s = rng.randint(1, capacity)
                sizes[s] = sizes.get(s, 0) + 1
            runs = boxes.pack(sizes, capacity)
            assert all(sum(s * k for s, k in content.items()) <= capacity for _, content in runs)
            used: dict[int, int] = {}
            for many, content in runs:
                for s, k in content.items():
                    used[s] = used.get(s, 0) + many * k
            assert used == sizes
            least = -(-sum(s * k for s, k in sizes.items()) // capacity)
            assert sum(many for many, _ in runs) <= 1.25 * least + 2
    assert boxes.dominating([3, 5], {3: 1, 5: 1}, 8) == [5, 3] and boxes.dominating([4, 5], {4: 2, 5: 1}, 8) is None and boxes.dominating([3, 6], {3: 1, 6: 1}, 7) == [6]
    assert sorted(boxes.pack({6: 2, 4: 2, 3: 1}, 10)) == [(1, {3: 1}), (2, {6: 1, 4: 1})]
    assert boxes.pack({}, 10) == []


def least_boxes(items, capacity):
    """The least number of boxes, by trying where each item may go."""
    best = len(items)

    def put(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(items):
            best = len(loads)
            return
        for j in {load: j for j, load in enumerate(loads) if load + items[i] <= capacity}.values():
            put(i + 1, loads[:j] + [loads[j] + items[i]] + loads[j + 1 :])
        put(i + 1, [*loads, items[i]])

    put(0, [])
    return best


def test_reduction_keeps_the_least_number_of_boxes():
    rng = random.Random(8)
    for _ in range(120):
        capacity = rng.randint(8, 30)
        items = sorted((rng.randint(capacity // 5, capacity) for _ in range(rng.randint(2, 9))), reverse=True)
        there: dict[int, int] = {}
        for x in items[1:]:
            there[x] = there.get(x, 0) + 1
        mates = sorted(x for x in there if x <= capacity - items[0])
        fixed = boxes.dominating(mates, there, capacity - items[0]) if mates else []
        if fixed is not None:
            rest = items[1:]
            for x in fixed:
                rest.remove(x)
            assert items[0] + sum(fixed) <= capacity and 1 + least_boxes(rest, capacity) == least_boxes(items, capacity), (items, capacity, fixed)


def test_filled_boxes(spark):
    texts = [(1, "word " * 700), (2, "a b c"), (3, ""), (4, None), (5, "d e f"), (6, "word " * 30)]
    kinds = spark.createDataFrame([("small", 64), ("none", 0)], "box string, capacity_tokens long")
    rows = boxes.filled_boxes(spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, rank int, box int"), kinds).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 5, 6}
    load: dict[int, int] = {}
    for r in rows:
        load[r["bin"]] = load.get(r["bin"], 0) + r["tokens"]
    assert max(load.values()) <= 64
    parts = sorted((r["start_token"], r["tokens"]) for r in rows if r["doc_id"] == 1)
    assert [a + n for a, n in parts[:-1]] == [a for a, _ in parts[1:]] and len([r for r in rows if r["doc_id"] == 6]) == 1
    assert boxes.filled_boxes(spark.createDataFrame([], "doc_id long, text string"), kinds).count() == 0


def test_flow_prefers_first_uses():
    patterns = {("a",): 10.0, ("a", "b"): 10.0, ("b",): 2.0}
    flow = mixture.min_cost_flow(patterns, {"a": 10.0, "b": 12.0}, {"a": 3, "b": 3})
    assert abs(flow[("a",), "a"] - 10) < 1e-3 and abs(flow[("a", "b"), "b"] - 10) < 1e-3
    assert abs(mixture.reachable_total({("a",): 10.0}, {"a": 0.5, "none": 0.5}, {"a": 2, "none": 1}) - 40) < 1e-3


def test_mixture(spark):
    docs = [(i, f"m{i}", "a" if i % 2 else "b", "word " * 20) for i in range(200)] + [(900, "m1", "b", "word " * 20), (901, "x", None, "t"), (902, "y", "a", None), (903, "z", "other", "t")]
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.5, 2), ("ghost", 0.25, 4)], "source string, target_share double, max_repeats long")
    mixed = mixture.mixed_documents(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, message_id string, source string, text string, tokens int"), targets)
    report = {r["source"]: r for r in mixture.mix_report(mixed, targets).collect()}
    assert report["a"]["most_uses"] <= 1 and report["b"]["most_uses"] <= 2 and report["ghost"]["tokens"] == 0
    assert abs(report["a"]["reached_share"] - 1 / 3) < 0.03 and abs(report["b"]["reached_share"] - 2 / 3) < 0.03


def test_a_scarce_source_takes_nothing_from_the_others(spark):
    columns = "doc_id long, message_id string, source string, text string, mass int"
    docs = [(10**18 + i, f"m{i}", "a", "word " * 20, 0) for i in range(200)] + [(5, None, "b", "t", 0), (-(2**63), "low", "c", "word", 0)]
    df = spark.createDataFrame(docs, columns)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats long")
    report = {r["source"]: r for r in mixture.mix_report(mixture.mixed_documents(df, targets), targets).collect()}
    each = report["a"]["tokens"] / report["a"]["documents"]
    assert abs(report["a"]["tokens"] - (200 * each + 1) / 2) <= each and report["b"]["tokens"] == 2
    exact = {r["source"]: r for r in mixture.mix_report(mixture.mixed_documents(df, targets, exact_shares=True), targets).collect()}
    assert exact["a"]["documents"] == 1 and exact["b"]["tokens"] == 2
    assert mixture.mixed_documents(df.where("false"), targets).count() == 0 and mixture.mixed_documents(df, targets.where("false")).count() == 0


CASES = [
    ("Dear Mr. Smith,\n\nIt cost 3.5 at 5 p.m. today. We left... Still, go! \"No,\" she said, \"wait.\" P.S. Call Dr. No at once\n-- \nJoe", ["Dear Mr. Smith,", "It cost 3.5 at 5 p.m. today.", "We left...", "Still, go!", '"No," she said, "wait."', "P.S. Call Dr. No at once"]),
    ("Subject: x\nContent-Type: text/plain\n\nOne.\nOn Monday A wrote:\n> Quoted. Text.\nTwo\r\nlines? Three.Four it is.\n_____ off", ["One.", "Two\r\nlines?", "Three.", "Four it is."]),
    ("「鍵は？」と聞いた。次です！“哪里？”他问。好。“是？”他说。", ["「鍵は？」と聞いた。", "次です！", "“哪里？”他问。", "好。", "“是？”他说。"]),
    ("Τι είναι; Ο κ. Άλφα ήρθε.", ["Τι είναι;", "Ο κ. Άλφα ήρθε."]),
    ("„Kommen Sie?“, fragte er am 3. März. Dr. X hat z. B. nichts. « Où ? » demanda-t-il. «Где?» — спросил он. Да.", ["„Kommen Sie?“, fragte er am 3. März.", "Dr. X hat z. B. nichts.", "« Où ? » demanda-t-il.", "«Где?» — спросил он.", "Да."]),
    ("หนึ่ง สอง\nสาม", ["หนึ่ง", "สอง", "สาม"]),
    ("Content-Type: multipart/mixed; boundary=\"b1\"\n\n--b1\nContent-Type: text/html\n\n<p>No.</p>\n--b1\nContent-Type: text/plain\n\nYes. 🙂 Done.\n--b1--\nTail.", ["Yes.", "🙂 Done."]),
    ("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\nQUJD\n", []), ("Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/html\n\nNo.\n", []), ("", []), (None, []), ("   \n", []),
    ("From a@b Mon\nTo: x\n", []),
    ("Hello my friend, the word สวัสดี means hello. Thanks for the note.", ["Hello my friend, the word สวัสดี means hello.", "Thanks for the note."]),
    ("The U.S. Senate met. It left the U.K. Still, Jan. 5 is fine. Vgl. Seite 5. See https://a.example/x.y?q=1.5" + "/z" * 200 + ".Html now. Www.b.example is down.", ["The U.S. Senate met.", "It left the U.K.", "Still, Jan. 5 is fine.", "Vgl. Seite 5.", "See https://a.example/x.y?q=1.5" + "/z" * 200 + ".Html now.", "Www.b.example is down."]),
    ("Բարեւ ձեզ։ Ինչպես եք։", ["Բարեւ ձեզ։", "Ինչպես եք։"]), ("გამარჯობა. როგორ ხარ?", ["გამარჯობა.", "როგორ ხარ?"]), ("សួស្តី។ អរគុណ។", ["សួស្តី។", "អរគុណ។"]), ("ሰላም።እንዴት ነህ።", ["ሰላም።", "እንዴት ነህ።"]), ("မင်္ဂလာပါ။နေကောင်းလား။", ["မင်္ဂလာပါ။", "နေကောင်းလား။"]),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, t, 0) for i, (t, _) in enumerate(CASES)], "doc_id long, text string, pieces int")
    got: dict[int, list[str]] = {i: [] for i in range(len(CASES))}
    for r in sorted(sentences.sentences(df).collect(), key=lambda r: (r["doc_id"], r["start_at"])):
        got[r["doc_id"]].append(CASES[r["doc_id"]][0][r["start_at"] : r["end_at"]])
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text
    assert sentences.sentences(df.where("false")).count() == 0
    one = spark.createDataFrame([(1, "See the Abt. Nord. Done.")], "doc_id long, text string")
    assert [sentences.sentences(one, more=m).count() for m in ((), ("abt",))] == [3, 2]


def test_long_text_has_all_sentences(spark):
    df = spark.createDataFrame([(1, "One is here. " * 5000)], "doc_id long, text string")
    rows = sentences.sentences(df).collect()
    assert len(rows) == 5000 and {r["start_at"] % 13 for r in rows} == {0}
