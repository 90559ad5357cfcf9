"""Embeddings, mixing, language ID, rollups, WARC, licences and the pipeline."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillsift.llm import langid
from quillsift.llm.embedding_dedup import dedup_embeddings, embedding_links, quantised, unit
from quillsift.llm.langid import held_out, identify, keep_identified, learn
from quillsift.llm.licenses import TEMPLATES, license_matches, telling, template_bigrams
from quillsift.llm.mixing import entropy, exponent_for, mix_sources, mixing_schedule, repeats, weights
from quillsift.llm.token_rollup import TokenRollup, byte_bpe, counted, counted_each, deleted, inserted, of_version, revised
from quillsift.llm.warc import chunks, page_records, parse, read_payloads, read_warc, write_warc


@pytest.mark.parametrize("block", [8192, 7])
def test_embedding_links(spark, block):
    g = np.random.default_rng(4)
    x = g.normal(size=(60, 16))
    x[20:40] = x[3] + 0.25 * g.normal(size=(20, 16))
    x[40] = x[3] * 7
    x[41] = x[42] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100, None), (101, []), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [None, *[1.0] * 15]), (105, [1.0, 2.0]), (106, [2.0, 4.0]), (107, [float("inf")] * 16), (3, x[3].tolist())]
    df = spark.createDataFrame([(k, v, k % 3, "z") for k, v in rows], "vec_id long, embedding array<double>, label int, rep string")
    u = unit(x)
    link = u @ u.T >= 0.9
    comp = {k: k for k in range(60)}
    for _ in range(60):
        comp = {k: min(comp[j] for j in range(60) if link[k, j]) for k in range(60)}
    got = {r[0]: (r[1], r[2], r[3]) for r in embedding_links(df, 0.9, block=block).collect()}
    want = {k: (int(link[k].sum()) - 1, comp[k], comp[k] == k) for k in range(60)} | {k: (0, k, True) for k in (100, 101, 102, 103, 104, 107)} | {105: (1, 105, True), 106: (1, 105, False)}
    assert got == want
    assert embedding_links(df.limit(0)).count() == 0


def test_vectors_of_one_id_stay_or_go_each_by_itself(spark):
    rows = [(1, [1.0, 0.0]), (5, [1.0, 0.01]), (5, [0.0, 1.0]), (5, None), (6, [0.01, 1.0]), (None, [1.0, 0.0])]
    left = dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [rows[0], rows[2], rows[3], rows[5]]))


def test_quantisation_bound_holds():
    x = unit(np.random.default_rng(1).normal(size=(200, 48)))
    q, s, a, e = quantised(x)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    assert (np.abs(x @ x.T - near) <= a[:, None] * e[None] + e[:, None] * a[None] + e[:, None] * e[None] + 1e-12).all()


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "q") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_pass string")


def test_exponent():
    t = np.array([1e3, 1e4, 1e6])
    a = exponent_for(t, entropy_share=0.9)
    assert abs(entropy(weights(t, a)) - 0.9 * math.log(3)) < 1e-6
    b = exponent_for(t, max_repeats=4)
    assert abs(repeats(t, b, None).max() - 4) < 1e-6 and repeats(t, b, None).min() > 0.999999
    assert exponent_for(np.array([5.0]), 0.5, 2) == 0.0 and exponent_for(np.array([5.0, 5.0]), None, 1.0) == 0.0


def test_mixing_meets_its_budgets(spark):
    r = random.Random(1)
    sizes = {"a": 400, "b": 60, "c": 9, None: 5}
    rows = [(k * 1000 + j, "w " * r.randint(1, 30), "en", s) for k, (s, n) in enumerate(sizes.items()) for j in range(n)]
    rows += [(9000, None, "en", "a"), (9001, "", None, "empty"), (None, "w w", "en", "a"), (9002, "w w w", "en", "c"), (9002, "w w w", "en", "c")]
    docs = documents(spark, rows)
    plan = mixing_schedule(docs, None, 4.0).collect()
    total = {s: sum(p["n"] for p in plan if p["s"] == s) for s in {p["s"] for p in plan}}
    t = np.array(sorted(v for v in total.values() if v), float)
    a = exponent_for(t, None, 4.0)
    budget = (t / weights(t, a)).max()
    for s, n in total.items():
        if n:
            want = budget * n**a / (t**a).sum()
            got = sum(p["n"] * p["passes"] for p in plan if p["s"] == s)
            assert want - 60 <= got <= want + 1 and all(math.floor(want / n + 1e-9) <= p["passes"] <= math.ceil(want / n) + 1 for p in plan if p["s"] == s)
    mixed = mix_sources(docs, None, 4.0)
    assert mixed.where("doc_id = 9002").count() == 2 * next(p["passes"] for p in plan if p["id"] == 9002)
    assert mixed.count() == sum(p["passes"] * (2 if p["id"] == 9002 else 1) for p in plan) and min(p["passes"] for p in plan) >= 1
    assert mixed.columns.count("mix_pass") == 1 and mix_sources(docs.limit(0)).count() == 0
    small = mixing_schedule(docs, 1.0, None, budget=300).collect()
    assert sum(p["n"] * p["passes"] for p in small) <= 301 and sorted(map(tuple, small), key=repr) == sorted(map(tuple, mixing_schedule(docs.repartition(5), 1.0, None, budget=300).collect()), key=repr)


def brute_exponent(t, entropy_share, max_repeats, budget):
    def split(a):
        x = [(v / max(t)) ** a for v in t]
        return [v / sum(x) for v in x]

    def spread(a):
        return -sum(w * math.log(w) for w in split(a)) <= entropy_share * math.log(len(t))

    def few(a):
        w = split(a)
        b = budget or max(v / x for v, x in zip(t, w, strict=True))
        return max(b * x / v for v, x in zip(t, w, strict=True)) <= max_repeats

    found = 0.0
    for good in [f for f, x in ((spread, entropy_share), (few, max_repeats)) if x is not None]:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good(mid) else (mid, hi)
        found = max(found, 0.0 if good(0.0) else hi)
    return found


def brute_blocks(units, room, block, order):
    """The units of the whole blocks that fit in turn, those of the first block that does not, and the room left."""
    out, blocks = [], {}
    for u in units:
        blocks.setdefault((u[order], u[block]), []).append(u)
    for key in sorted(blocks):
        size = sum(u["n"] for u in blocks[key])
        if size > room:
            return out, blocks[key], room
        out, room = out + blocks[key], room - size
    return out, [], 0


@pytest.mark.parametrize(("entropy_share", "max_repeats", "budget"), [(0.95, 4.0, None), (None, 1.5, None), (0.7, None, 9001)])
def test_mixing_against_a_plain_schedule(spark, entropy_share, max_repeats, budget):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    docs = docs.union(spark.createDataFrame([(-1, "w " * 40_000, "big"), (-2, None, "big"), (-3, "", None), (-4, "a b", None), (-5, "", "none")], docs.schema))
    keys = docs.selectExpr("doc_id", "source", "text", "xxhash64(text) as h").selectExpr("*", "pmod(xxhash64(21, doc_id, h), 256L) as b1", "pmod(xxhash64(22, doc_id, h), 256L) as b2", "xxhash64(23, doc_id, h) as o3")
    units = [r.asDict() for r in keys.selectExpr("*", "xxhash64(20, source, b1) as o1", "xxhash64(20, source, b1, b2) as o2").collect()]
    for u in units:
        u["n"] = len((u["text"] or "").split())
    total = Counter()
    for u in units:
        total[u["source"]] += u["n"]
    t = [v for v in total.values() if v]
    a = brute_exponent(t, entropy_share, max_repeats, budget)
    powers = {s: (v / max(t)) ** a if v else 0.0 for s, v in total.items()}
    weight = {s: x / sum(powers.values()) for s, x in powers.items()}
    whole = budget or max(total[s] / weight[s] for s in total if total[s])
    want, cut = {}, 0
    for s, v in total.items():
        mine = [u for u in units if u["source"] == s]
        tokens = round(weight[s] * whole)
        passes, room = divmod(tokens, v) if v else (1, 0)
        want |= {u["doc_id"]: passes for u in mine}
        one, rest, room = brute_blocks([u for u in mine if u["n"]], room, "b1", "o1")
        two, rest, room = brute_blocks(rest, room, "b2", "o2")
        for u in sorted(rest, key=lambda u: u["o3"]):
            if u["n"] > room:
                cut += 1
                break
            two, room = [*two, u], room - u["n"]
        for u in one + two:
            want[u["doc_id"]] += 1
    plan = mixing_schedule(docs, entropy_share, max_repeats, budget).collect()
    assert {r["id"]: r["passes"] for r in plan} == want and len(plan) == len(want) and cut
    assert all(abs(r["weight"] - weight[r["s"]]) < 1e-9 for r in plan)
    rows = mix_sources(docs, entropy_share, max_repeats, budget).collect()
    assert Counter((r["doc_id"], r["mix_pass"]) for r in rows) == Counter((i, k) for i, n in want.items() for k in range(n))
    home = {u["doc_id"]: (u["source"], u["b1"]) for u in units}
    dealt = {(r["mix_block"], r["mix_pass"], *home[r["doc_id"]]) for r in rows}
    assert len(dealt) == len({x[0] for x in dealt}) == len({x[1:] for x in dealt}) and len({r["mix_rank"] for r in rows}) == len(rows)


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line, found = f" {' '.join(words)} ", Counter()
    for n in (1, 2, 3) if words else ():
        for g in (line[p : p + n] for p in range(len(line) - n + 1)):
            if (n == 1 and g != " ") or n == 2 or (n == 3 and g[1] != " "):
                found[g] += 1
    return found


def brute_order(grams, top):
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * k for k, c in enumerate(g))
    return {g: k for k, g in enumerate(sorted(grams, key=lambda g: (-grams[g], code(g)))[:top])}


@pytest.mark.parametrize("top", [400, 30])
def test_language_id_against_plain_ranks(spark, top):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [None, "", "12 %", "The THE the", "The THE the", "q", "the of and " * 20_000, "Éa ß İx 東京 9", "\x00a\n\tb"]
    extra = documents(spark, [(-1 - k // 2, t, "en" if k % 2 else "zz", "s") for k, t in enumerate(odd)] + [(None, "le la les", "fr", "s"), (-90, "ab ba", None, "s")])
    both = docs.union(extra.select(*docs.columns))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in both.collect()]
    grams = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            grams.setdefault(lang, Counter()).update(brute_grams(t))
    known, want = {lang: brute_order(g, top) for lang, g in grams.items() if g}, []
    for i, t, _ in rows:
        own = brute_order(brute_grams(t), top)
        out = {lang: sum(min(abs(ranks[g] - k), top) if g in ranks else top for g, k in own.items()) for lang, ranks in known.items()}
        best = min(sorted(out), key=out.get) if own else "und"
        want.append((i, best, 1.0 - out[best] / (top * len(own)) if own else 0.0))
    got = identify(both, learn(both, ~held_out("doc_id"), top=top)).select("doc_id", "lang_pred", "score").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len({x[1] for x in want}) > 3


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = documents(spark, [(-1, None, "en", "s"), (-2, "12 %", "en", "s"), (-3, "", None, "s"), (None, "the of", "en", "s")]).select(*docs.columns)
    both = docs.union(extra)
    known = learn(both, ~held_out("doc_id"))
    got = identify(both, known).join(both.select("doc_id", "lang", held_out("doc_id").alias("held")), "doc_id")
    test = got.where("held and doc_id >= 0")
    assert test.where("lang = lang_pred").count() >= 0.97 * test.count()
    assert {(r["lang_pred"], r["score"]) for r in got.where("doc_id < 0").collect()} == {("und", 0.0)}
    assert got.where("score < 0 or score > 1").count() == 0
    assert keep_identified(both, known).count() == docs.count() + 1
    none = learn(both.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in identify(docs.limit(5), none).collect()} == {"und"}


def test_language_stage_rejects_what_is_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = ["12,3 | 4.5 | q | 88 | z 10", "{}[]();;&&|| k == 0;", "#### 1 2 3 a 4 5 %%%", "Это русский текст о погоде", "9 8 7 6 5 4 3 e 2 1 0 " * 50]
    extra = documents(spark, [(-1 - k, t, "en", "s") for k, t in enumerate(noise)]).select(*docs.columns)
    left = corpus_pipeline.identify_language(spark, docs.union(extra), "")
    assert left.where("doc_id < 0").count() == 0 and left.count() >= 0.995 * docs.count()


def test_pipeline_learns_from_all_documents(spark, monkeypatch):
    seen, chosen = [], langid._chosen
    monkeypatch.setattr(langid, "_chosen", lambda *a: seen.append(chosen(*a)) or seen[-1])
    docs = spark.range(4_300).selectExpr("id as doc_id", "concat('some words ', id) as text", "'en' as lang")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 4_300
    assert [x.count() for x in seen] == [4_300, 4_300]


def test_rollup(spark, tmp_path):
    docs = documents(spark, [(1, "a b", "en", "x"), (2, "c", "en", "x"), (3, None, None, None), (4, "d-e f", "de", "y")])
    rollup, one = TokenRollup(spark, f"file://{tmp_path}/r"), lambda q, v="blank-1": counted(docs.where(q), v)
    assert rollup.totals().count() == 0
    assert rollup.commit("1", inserted(one("true"))) and not rollup.commit("1", inserted(one("true")))
    rollup.commit("2", deleted(one("doc_id = 2")))
    (tmp_path / "r/attempts/3-lost").mkdir()  # a writer that was lost
    assert rollup.batches() == ["1", "2"]
    rollup.commit("3", revised(one("doc_id = 4"), one("doc_id = 4", "alnum-1")))
    rollup.commit("4", one("false"))
    want = {("x", "en", "blank-1", 1, 2), (None, None, "blank-1", 1, 0), ("y", "de", "alnum-1", 1, 3)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.commit("5", deleted(one("doc_id = 1")))
    assert not rollup.commit("2", deleted(one("doc_id = 2"))) and {tuple(r) for r in rollup.totals().collect()} == want - {("x", "en", "blank-1", 1, 2)}
    with pytest.raises(ValueError):
        rollup.commit("../x", one("true"))
    lost = spark.range(1).selectExpr("'q' as source", "'q' as lang", "'q' as tokenizer", "7L as n_docs", "7L as n_tokens")
    lost.write.parquet(f"{rollup.path}/attempts/late")
    assert not rollup._put(f"{rollup.path}/attempts/late", f"{rollup.path}/batches/b-5")  # of two writers one wins
    assert "q" not in {r["source"] for r in rollup.totals().collect()}


def test_counts_of_one_pass(spark):
    docs = documents(spark, [(1, "a b", "en", "x"), (1, "a b", "en", "x"), (2, None, None, "x"), (3, "", "en", None), (4, "d-e f " * 50_000, "en", "x")]).withColumn("n", F.lit(1)).withColumn("tokenizer", F.lit("t"))
    both = counted_each(docs, {"blank-1": None, "alnum-1": None})
    for version in ("blank-1", "alnum-1"):
        assert sorted(map(repr, of_version(both, version).collect())) == sorted(map(repr, counted(docs, version).collect()))


def test_rollup_compacts_what_its_manifest_names(spark, tmp_path, monkeypatch):
    docs = documents(spark, [(1, "a b", "en", "x"), (2, "c", "en", "x")])
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    rollup.commit("1", inserted(counted(docs, "blank-1")))
    held = rollup._held
    monkeypatch.setattr(rollup, "_held", lambda: (held(), rollup.commit("2", inserted(counted(docs, "blank-1"))))[0])
    rollup.compact()
    monkeypatch.undo()
    assert [tuple(r) for r in rollup.totals().collect()] == [("x", "en", "blank-1", 4, 6)]


def test_byte_bpe(spark):
    public = pytest.importorskip("public_tokenizers")
    docs = documents(spark, [(1, "hello world", "en", "x"), (2, None, "en", "x")])
    rows = counted(docs, "bpe", byte_bpe(spark, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2]


def test_warc_of_repeated_pages_and_payloads_of_several_chunks(spark, tmp_path):
    long = "".join(f"{k} é " for k in range(400_000))
    pages = [(1, "u", long), (1, "u", long), (2, "u", long), (3, "u", "y" * 100), (3, "v", "z" * 100), (3, "v", None), (4, "u", "z" * 100), (5, "u", "z" * 99), (6, "u", "z" * 99)]
    got = page_records(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w").collect()
    want = []
    for i, _, html in pages:
        b = (html or "").encode()
        first = min(p for p, _, h in pages if h == html) if len(b) >= 100 else i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first < i else "response", first if first < i else None))
    assert len(long.encode()) > 3 << 20 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_warc(spark, tmp_path):
    mark = "\r\n\r\nWARC/1.1\r\n"
    pages = [(5, "http://a/b c", "x" * 150), (2, None, "x" * 150), (9, "u", "x" * 150), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", f"{mark}{mark}é" * 20), (10, "u", "a\r\n\r\n"), (11, "u", "long é " * 30_000), (12, "u", "W\r\n\r\n" * 60), (None, "u", "x" * 150), (13, "u", "WARC/1.1\r\n" * 9)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    first, want = {}, set()
    for i, _, html in sorted(p for p in pages if p[0] is not None):
        b = (html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        src = first.setdefault(d, i) if len(b) >= 100 else i
        want.add((i, len(b), d, "response" if src == i else "revisit", None if src == i else src))
    for size in (1 << 20, 1000, 64, 7):
        assert {tuple(r) for r in page_records(df, f"file://{tmp_path}/w{size}", chunk=size).collect()} == want
    write_warc(df, f"file://{tmp_path}/again", chunk=64)
    whole = {}
    for r in read_warc(spark, f"file://{tmp_path}/again").orderBy("id", "segment").collect():
        whole[r["id"]] = whole.get(r["id"], b"") + bytes(r["part"])
    assert whole == {i: b"" if i in (5, 9) else (h or "").encode() for i, _, h in pages if i is not None}
    assert page_records(df.limit(0), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        parse(b"WARC/1.1\r\nWARC-Record-ID: x\r\nContent-Length: 5\r\n\r\nabc")


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_warc_writes_every_row_of_a_repeated_id(spark, tmp_path, size):
    a, b, c = "a" * 300, "b" * 250, "c" * 200
    pages = [(5, "u", a), (5, "u", a), (5, "v", a), (5, "u", b), (7, "u", a), (7, "u", a), (7, "u", b), (4, "u", c), (4, "u", c), (6, "u", c), (8, "u", None), (8, "u", "short"), (8, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        src = min(j for j, _, h in pages if h == html)
        again = len(data) >= 100 and src < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", src if again else None))
    got = page_records(df.repartition(3), f"file://{tmp_path}/w", chunk=size).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    table = read_warc(spark, f"file://{tmp_path}/w").collect()
    keys = [(r["id"], r["copy"], r["segment"]) for r in table]
    payloads = {}
    for r in sorted(table, key=lambda r: (r["id"], r["copy"], r["segment"])):
        payloads[r["id"], r["copy"]] = payloads.get((r["id"], r["copy"]), b"") + bytes(r["part"])
    assert len(keys) == len(set(keys)) and sorted(payloads) == sorted((i, k) for i in {p[0] for p in pages} for k in range(sum(p[0] == i for p in pages)))
    assert all(hashlib.sha256(payloads[r["refers_to"], r["refers_copy"]]).hexdigest() == r["digest"] for r in table if r["type"] == "revisit")


@pytest.mark.parametrize("wrong", ["running", "part", "response"])
def test_warc_reading_checks_running_digests_and_revisits(spark, tmp_path, wrong):
    body = "".join(f"word{k} " for k in range(30))
    write_warc(spark.createDataFrame([(1, "u", body), (2, "u", body)], "page_id long, url string, html string"), f"file://{tmp_path}/w", chunk=64)
    for r in read_warc(spark, f"file://{tmp_path}/w").where("type <> 'revisit'").collect():
        assert r["running"] == hashlib.sha256(body.encode()[: 64 * (r["segment"] + 1)]).hexdigest()
    assert read_payloads(spark, f"file://{tmp_path}/w").count() == 2
    files = [f for f in (tmp_path / "w").glob("part-*") if f.stat().st_size]
    (tmp_path / "x").mkdir()
    for f in files:
        data = f.read_bytes()
        if wrong == "part":
            data = data.replace(b"word20 ", b"word2x ")
        elif wrong == "running":
            digest = hashlib.sha256(body.encode()[:128]).hexdigest().encode()
            data = data.replace(b"X-Running-Digest: sha256:" + digest, b"X-Running-Digest: sha256:" + b"0" * 64)
        else:
            data = data.replace(b"WARC-Refers-To: <urn:quillsift:record:1>", b"WARC-Refers-To: <urn:quillsift:record:3>")
        (tmp_path / "x" / f.name).write_bytes(data)
    with pytest.raises(Exception, match="no response" if wrong == "response" else "is not the one to follow"):
        read_payloads(spark, f"file://{tmp_path}/x").count()


def test_chunks_carry_running_digests():
    data = bytes(range(256)) * 10
    parts = list(chunks(data, 100))
    assert b"".join(p for _, p, _ in parts) == data and [k for k, _, _ in parts] == list(range(26))
    assert all(d == hashlib.sha256(data[: 100 * (k + 1)]).hexdigest() for k, _, d in parts)


def test_licenses(spark):
    mit = TEMPLATES["MIT"][2]
    rows = [(1, f"text\n{TEMPLATES['MIT'][0].upper()}\nmore"), (2, mit.replace(", ", ",\n") + "\n\nrest of it"), (3, "Released under the"), (4, None), (5, ""), (6, "..."), (7, "Licensed under the MPL License"), (8, "no licence here " * 2000), (None, TEMPLATES["MIT"][0])]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in license_matches(df).collect()}
    for i, t in rows:
        units = [*(t or "").split("\n"), *(p for p in __import__("re").split("\n[ \t\r]*\n", t or "") if "\n" in p)]
        for name, texts in TEMPLATES.items():
            best = []
            for u in units:
                a = set(template_bigrams(u))
                scores = [Fraction(2 * len(a & set(b)), len(a) + len(b)) for b in map(template_bigrams, texts)] if a else []
                best += [max(scores)] if scores and max(scores) >= Fraction(4, 5) else []
            assert got.get((i, name)) == ((float(max(best)), len(best)) if best else None), (i, name)
    assert license_matches(df.limit(0)).count() == 0


def test_a_match_holds_a_telling_word():
    import re

    t, known = Fraction(4, 5), [template_bigrams(x) for texts in TEMPLATES.values() for x in texts]
    pattern = re.compile(telling(known, t))
    assert not pattern.search("It is by chance that in the long text of this page nothing is said of them") and pattern.search("CC BY--NC")
    for bigrams in known:
        kept = [b for b in bigrams if not pattern.search(b)]
        assert not kept or Fraction(2 * len(kept), len(kept) + len(bigrams)) < t


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name}-{random.random()}"
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or after.columns == docs.columns)
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    assert before.select("doc_id").distinct().count() > 0.8 * docs.count()
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, before.collect()))


def test_nothing_else_imports_the_operators():
    import subprocess

    code = "import sys; import quillsift.plans.engine, quillsift.plans.queries, quillsift.streaming.stateless; print([m for m in sys.modules if 'quillsift.llm' in m])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).stdout.strip().endswith("[]")
