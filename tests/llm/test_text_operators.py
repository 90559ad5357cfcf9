"""Operators on documents against brute force: null, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import ngram_join, substring_dedup
from quillsift.llm.common import shingle_set, text_bytes
from quillsift.llm.components import connected_components
from quillsift.llm.decontaminate import SuffixAutomaton, contamination_report, decontaminate
from quillsift.llm.line_dedup import dedup_lines
from quillsift.llm.ngram_join import dedup_ngrams, jaccard_groups
from quillsift.llm.substring_dedup import dedup_substrings, phrases

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, f long, h long, __id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, 2, 3, 4, "x") for i, t in rows], SCHEMA)


def corpus(seed=1, copies=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(70)
    rows = [(100 + k, text(r.randint(1, 200))) for k in range(20)]
    for k in range(copies):
        words = base.split()
        for _ in range(k % 5):
            words[r.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    rows += [(200 + k, f"{text(20 + k)} {passage} {text(30)}") for k in range(8)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "One"), (304, "one"), (305, text(5000)), (305, text(5000)), (306, base), (306, base), (None, base), (307, passage + " " + passage), (308, "É é É")]
    return rows


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_groups(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = ws(ascii_lower(t))
        sets.append((i, {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    ids = {i: i for i, _ in sets if i is not None}
    find = lambda x: x if ids[x] == x else find(ids[x])
    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and i != j and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                ids[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, k, num):
    rows = [x for x in corpus(copies=40) if x[0] != 305]
    got = jaccard_groups(table(spark, rows).repartition(3), k, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows, k, num, 100)


@pytest.mark.parametrize(("k", "num", "seed", "lengths"), [(3, 90, 5, 2), (5, 80, 7, 1)])
def test_near_copies_by_their_hubs(spark, monkeypatch, k, num, seed, lengths):
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "LENGTHS", lengths)
    monkeypatch.setattr(ngram_join, "LEAST", 2)
    spokes = []
    longer = ngram_join._longer
    monkeypatch.setattr(ngram_join, "_longer", lambda s: spokes.append(s.count()) or longer(s))
    r = random.Random(seed)
    base, rows = [f"w{r.randrange(400)}" for _ in range(150)], []
    for i in range(160):
        words = base.copy()
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 7])):
            at = r.randrange(len(words) - 3)
            words[at : at + r.randint(0, 2)] = [f"w{r.randrange(400)}" for _ in range(r.randint(0, 2))]
        rows.append((i, " ".join(words)))
        if i % 10 == 0:
            base = words
    got = jaccard_groups(table(spark, rows).repartition(3), k, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows, k, num, 100)
    assert len(spokes) == lengths and min(spokes) > 50


def test_ranks_do_not_depend_on_how_rows_lie(spark):
    docs = table(spark, [(i, f"{i} one two three") for i in range(60)]).select(text_bytes("text").alias("text"))
    a, b = (ngram_join._ranks(docs.repartition(n), 3) for n in (1, 60))
    assert a.often == b.often and np.array_equal(a.levels, b.levels)
    assert a.of(shingle_set(b"one two three", 3))[0] == ngram_join.level(np.array(60)) >= a.often


def test_full_counters_make_no_token_frequent(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTERS", 1024)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(1_202)) + " one two three") for i in range(300)]
    ranks = ngram_join._ranks(table(spark, rows).select(text_bytes("text").alias("text")), 3)
    assert (ranks.levels >= ranks.often).mean() < 0.02 and len(np.unique(ranks.levels)) > 32
    assert ranks.of(shingle_set(b"one two three", 3))[0] >= ranks.often


def test_far_members_of_a_hub_hand_on_few_tokens(spark):
    node = lambda f: {"id": f, "f": f}
    sets = spark.createDataFrame([(node(1), list(range(200))), (node(2), [0, *range(1000, 1199)]), (node(3), [*range(195), 5000])], "f struct<id:long,f:long>, s array<long>")
    rows = spark.createDataFrame([(node(1), node(2), 0), (node(1), node(3), 0)], "hub struct<id:long,f:long>, node struct<id:long,f:long>, off long")
    found = {r["node"]["id"]: r for r in ngram_join._spokes(rows, sets, 90, 100).collect()}
    assert found[2]["k"] == 398 and not found[2]["linked"] and found[2]["d"] == list(range(1000, 1023)) and found[2]["short"] == 23
    assert found[3]["k"] == 6 and found[3]["linked"] and len(found[3]["d"]) == found[3]["short"]


def test_far_differences_from_a_hub_make_no_pair(spark):
    node = lambda f: {"id": f, "f": f}
    odd, even = {100, *range(1, 80, 2)}, {100, *range(0, 80, 2)}
    sets = spark.createDataFrame([(node(f), [t for t in range(200) if t not in lost]) for f, lost in [(1, set()), (2, odd), (3, even), (4, odd | {150})]], "f struct<id:long,f:long>, s array<long>")
    rows = spark.createDataFrame([(node(1), node(f), 0) for f in (2, 3, 4)], "hub struct<id:long,f:long>, node struct<id:long,f:long>, off long")
    spokes = ngram_join._spokes(rows, sets, 80, 100)
    assert {r["node"]["id"]: r["d"][:2] for r in spokes.collect()} == {2: [100, 79], 3: [100, 78], 4: [150, 100]}
    pairs = ngram_join._token_pairs(ngram_join._longer(spokes.withColumn("comp", spokes["node"])), 80, 100)
    assert [(r["a"]["id"], r["b"]["id"]) for r in pairs.collect()] == [(2, 4)]


def test_chance_repeats_have_no_hub(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST", 40)
    spokes, longer = [], ngram_join._longer
    monkeypatch.setattr(ngram_join, "_longer", lambda s: spokes.append(s.count()) or longer(s))
    rows = [(i, f"a b c d e u{i} v{i}") for i in range(30)] + [(99, "a b c d e u7 v7 w")]
    got = jaccard_groups(table(spark, rows).repartition(3), 3, 60, 100).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_groups(rows, 3, 60, 100)
    assert sum(spokes) == 0


def test_one_of_each_group_stays(spark):
    rows = [x for x in corpus() if x[0] != 305]
    docs = table(spark, rows)
    keep = {i for i, _, c in brute_groups(rows, 5, 80, 100) if i == c}
    left = dedup_ngrams(docs)
    assert left.columns == docs.columns and sorted(map(repr, (r[0] for r in left.collect()))) == sorted(repr(i) for i, _ in rows if i in keep)


def test_texts_of_one_id_stay_or_go_each_by_itself(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(100)) for x in "ab")
    rows = [(1, a), (5, a + " more"), (5, a + " more"), (5, b), (5, None), (6, b + " more"), (None, a)]
    left = dedup_ngrams(table(spark, rows))
    assert sorted(map(repr, left.select("doc_id", "text").collect())) == sorted(map(repr, table(spark, [(1, a), (5, b), (5, None), (None, a)]).select("doc_id", "text").collect()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 51), (51, 50), (60, 60), (None, 3), (70, 10)] + [(100, x) for x in range(101, 140)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(21), 70]} | {50: 50, 51: 50} | {k: 100 for k in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hits(text, items, size):
    words, hit, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text)), set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(item))
        n = min(size, len(w))
        windows = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if n else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, text(r.randint(4, 20))) for k in range(12)] + [(20, "W1, w2;w3"), (21, "w1 w2 w3"), (22, None), (23, "..."), (24, "été É x")]
    rows = [(k, text(60)) for k in range(15)] + [(k + 50, f"zz {items[k][1].upper()} yy {text(10)}") for k in range(12)] + [(90, None), (91, ""), (92, "w1-w2_w3"), (None, items[0][1]), (93, items[1][1]), (93, items[1][1]), (94, "Été É x")]
    bench = spark.createDataFrame([*items, (None, "w5 w6")], "item_id long, text string")
    want = sorted(((i, *brute_hits(t, items, 6)) for i, t in rows), key=repr)
    for most in (10_000, 25):  # one automaton, several
        got = contamination_report(table(spark, rows), bench, window=6, max_words=most)
        got = got if most > 25 else got
        assert sorted({tuple(x) for x in got.collect()}, key=repr) == sorted(set(want), key=repr)
    assert contamination_report(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert contamination_report(table(spark, rows).limit(0), bench).count() == 0


def test_contamination_has_a_row_per_row_for_any_number_of_automata(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(8))) for k in range(6)]
    rows = [(1, items[0][1]), (1, items[0][1]), (1, items[3][1]), (None, items[1][1]), (None, items[1][1]), (None, None), (2, None), (2, None), (3, f"{items[0][1]} x {items[5][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute_hits(t, items, 6)) for i, t in rows), key=repr)
    for most in (10_000, 10):
        got = contamination_report(table(spark, rows), bench, window=6, max_words=most).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_decontaminate(spark):
    item = " ".join(f"b{k}" for k in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Intro here. {item.upper()}! And an end to it, which is long enough to stay."), (2, item), (3, "clean text"), (4, None), (5, "b0 b1 b2 b3")]
    got = {r["doc_id"]: r for r in decontaminate(table(spark, rows), bench).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1]["text"] == "Intro here. ! And an end to it, which is long enough to stay." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == "clean text" and got[4]["text"] is None and got[1]["__id"] == "x"


def test_automaton_is_exact():
    r = random.Random(3)
    for _ in range(60):
        items = [(str(k), [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 9))]) for k in range(r.randint(1, 5))]
        text = [r.choice([b"a", b"b", b"c", b"x"]) for _ in range(40)]
        spans, found = SuffixAutomaton(items, 4).hits(text)
        covered = {p for a, b in spans for p in range(a, b)}
        hit, names = set(), set()
        for name, w in items:
            n = min(4, len(w))
            for q in range(len(w) - n + 1):
                for p in range(len(text) - n + 1):
                    if text[p : p + n] == w[q : q + n]:
                        hit |= set(range(p, p + n))
                        names.add(name)
        assert (covered, found) == (hit, names)


def brute_lines(rows):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        lines = (t or "").split("\n")
        norm, gone = [x.strip(" \t\r") for x in lines], set()
        for p in range(len(lines) - 2):
            w = tuple(norm[p : p + 3])
            if any(w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return out


def test_line_dedup(spark):
    r = random.Random(2)
    rows = [(k, "\n".join(r.choice(["a", "b ", " c\r", "", "\t"]) for _ in range(r.randint(0, 12)))) for k in range(40)] + [(50, None), (51, "a\nb"), (52, "a\na\na\na\na"), (53, "\n" * 9), (54, "x y\n" * 20_000)]
    got = dedup_lines(table(spark, [*rows, (None, rows[3][1])]).repartition(3), counts=True)
    assert sorted((x["doc_id"], x["text"], x["n_removed"]) for x in got.where("doc_id is not null").collect()) == brute_lines(rows)
    assert got.where("doc_id is null").first()["text"] == rows[3][1]
    assert dedup_lines(table(spark, rows).limit(0)).count() == 0


def brute_substrings(rows, size):
    first, out = {}, []
    for i, t in rows:
        w = ws(t)
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    for i, t in rows:
        w, gone = ws(t), set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p : p + size])] < i:
                gone |= set(range(p, p + size))
        out.append((i, None if t is None else " ".join(x for p, x in enumerate(w) if p not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 12, 5])
def test_substring_dedup(spark, size):
    rows = corpus(7)
    got = dedup_substrings(table(spark, rows).repartition(4), size).select("doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_substrings(rows, size)


def test_phrases_cover_all_windows():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64)
    _, a, b = phrases(h, 20)
    assert a[0] == 0 and b[-1] == 381 and (a[1:] == b[:-1]).all()


@pytest.mark.parametrize("num", [30, 50, 101])
def test_thresholds_without_complete_candidates_are_refused(spark, num):
    with pytest.raises(ValueError, match="threshold"):
        jaccard_groups(table(spark, [(1, "a"), (2, "a b")]), 1, num, 100)


def test_empty_tables(spark):
    none = table(spark, corpus()).limit(0)
    assert jaccard_groups(none).count() == 0 and dedup_substrings(none).count() == 0
    assert dedup_substrings(table(spark, [(1, None), (2, "")])).where(F.col("n_words") > 0).count() == 0


def test_substring_tables_go_when_nothing_reads_them(spark, monkeypatch):
    made, plain = {}, substring_dedup.cut

    def cut(df, label):
        out = plain(df, label)
        made[label] = Path(urlparse(out.inputFiles()[0]).path)
        return out

    monkeypatch.setattr(substring_dedup, "cut", cut)
    text = " ".join(f"w{k}" for k in range(90))
    found = substring_dedup.duplicate_ranges(table(spark, [(1, text), (2, "a " + text)]))
    assert [r["id"] for r in found.collect()] == [2]
    assert {label for label, path in made.items() if path.exists()} == {"found", "edges"}
