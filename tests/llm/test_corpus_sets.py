"""Collocations, line runs and bottom-k sketches: odd tables, several batches, bounds and brute force."""

import random
from collections import Counter

import pytest

pytest.importorskip("tallymark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tallymark.llm import distinct, lines, phrases  # noqa: E402
from tallymark.llm.common import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, a long, n long, h binary, gone string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, b"", "x") for i, t, lang in rows], DOCS)


def plain_collocations(rows, max_n, least, share, top):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for n in range(1, max_n + 1):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    long = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in long.items():
        if any(m == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (m, v), b in long.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i, p.decode(), -a, x, y, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}


@pytest.mark.parametrize("max_n", [2, 3, 4, 5])
def test_collocations_of_odd_tables(spark, max_n):
    rng = random.Random(max_n)
    rows = [(i, None if i % 19 == 0 else "".join(rng.choice(["New ", "york\t", "Ünder ", "the  ", "x", ". ", "\n", "city hall ", "\x0b", "a\u00a0b "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", None, "fr"])) for i in range(120)]
    rows += rows[:10] + [(500, "very long " * 20_000, "en"), (None, "", "de")]
    got = phrases.collocations(docs(spark, rows), Scratch(spark, "t"), max_n=max_n, least=5, share=60, top=12)
    assert set(map(tuple, got.collect())) == plain_collocations(rows, max_n, 5, 60, 12)
    assert phrases.collocations(docs(spark, rows[:0]), Scratch(spark, "t"), max_n=max_n).collect() == []


def test_scores_are_exact_where_products_pass_64_bits(spark, monkeypatch):
    a, l, r = 10**17 + 1, 10**17 + 7, 10**17 + 3
    counts = spark.createDataFrame([("en", 0, "", 10**18), ("en", 1, "p", l), ("en", 1, "q", r), ("en", 2, "p q", a)], "lang string, n int, gram string, a long")
    monkeypatch.setattr(phrases, "gram_counts", lambda *_, **__: counts)
    got = phrases.collocations(docs(spark, []), Scratch(spark, "t")).collect()
    assert [tuple(x) for x in got] == [("en", 1, "p q", a, l, r, 10**18, 2000000 * a // (l + r))]


def test_pair_filter_never_stops_a_frequent_pair(spark):
    import pyarrow as pa

    rows = [("en", f"w{i} v{i * 7}") for i in range(3000)] + [("fr", "été hiver")]
    bits = phrases.pair_filter(spark.createDataFrame(rows, "lang string, gram string"))
    hashed = [phrases._text_hashes(pa.array(x)) for x in zip(*[(lang, *gram.split(" ")) for lang, gram in rows])]
    assert phrases._passes(bits, phrases._bits(*hashed)).all()
    other = [phrases._text_hashes(pa.array(x)) for x in zip(*[("en", f"w{i}", f"z{i}") for i in range(3000)])]
    assert phrases._passes(bits, phrases._bits(*other)).mean() < 0.01


def plain_lines(rows, at_least, shortest):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    f = Counter(k for _, text, _ in rows for k in {key(x) for x in (text or "").split("\n")})
    out = []
    for i, text, _ in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < shortest or f[key(x)] < at_least]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (5, 2), (7, 3)])
def test_lines_of_odd_tables(spark, batches, fan):
    rng = random.Random(batches)
    pool = [" Home ", "home", "HOME\r", "", "  ", "Terms of use", "É", "é", "x" * 5000, "a\u00a0", "\u00a0a"] + [f"only {i}" for i in range(40)]
    rows = [(i % 50, None if i % 17 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9))), "en") for i in range(150)]
    rows += [(None, "home\nx\n\n", None), (None, "home", None), (7, "only 1\n" * 3000, "en")] + rows[:5]
    for at_least, shortest in ((10, 1), (3, 4)):
        got = lines.drop_repeated(docs(spark, rows), Scratch(spark, "t"), at_least=at_least, shortest=shortest, batches=batches, fan=fan)
        assert sorted(map(tuple, got.collect()), key=str) == plain_lines(rows, at_least, shortest)
    assert lines.drop_repeated(docs(spark, []), Scratch(spark, "t")).collect() == []


def test_runs_are_levelled_and_know_what_was_seen(spark):
    store = lines.LineRuns(spark, Scratch(spark, "t"), at_least=1, fan=2, buckets=3)
    seen = set()
    for k in range(7):
        batch = {f"line {i}" for i in range(k * 5, k * 5 + 12)}
        rows = spark.createDataFrame([(x.encode(),) for x in batch], "h binary")
        fresh = {bytes(r.h).decode() for r in store.unsettled(rows.groupBy("h").agg(F.count("*").alias("n"))).collect()}
        assert fresh == batch - seen
        store.add(rows)
        seen |= batch
    assert [len(level) for level in store.levels] == [1, 1, 1]
    plan = store.unsettled(rows.groupBy("h").agg(F.count("*").alias("n")))._jdf.queryExecution().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Bucketed: true" in plan
    store.close()


def test_sketches_merge_and_bound_what_they_estimate(spark):
    rng = random.Random(1)
    rows = [(i, kind, day) for kind, ids in (("a", range(0, 4000)), ("b", range(3000, 9000)), ("c", range(60))) for i in ids for day in rng.sample(range(3), 1 if i % 3 else 2)]
    used = spark.createDataFrame(rows, "member long, name string, day long")
    daily = distinct.sketches(used, Scratch(spark, "t"), k=256)
    found = {(r.name, r.day): r.sketch for r in daily.collect()}
    of = {i: h for i, h in spark.range(9000).select("id", F.xxhash64("id")).collect()}
    for (kind, day), sketch in found.items():
        assert sketch == sorted({of[i] for i, k, d in rows if (k, d) == (kind, day)})[:256]
    merged = {(r.name, r.day): r.sketch for r in distinct.windows(daily, 3, 0, 256).collect()}
    for kind in "abc":
        assert merged[kind, 2] == sorted({of[i] for i, k, _ in rows if k == kind})[:256]
    pairs = spark.createDataFrame([(merged[x, 2], merged[y, 2], x, y) for x in "abc" for y in "abc"] + [([], [], "n", "n")], "a array<long>, b array<long>, x string, y string")
    ids = {k: {i for i, kind, _ in rows if kind == k} for k in "abc"} | {"n": set()}
    for r in pairs.select("x", "y", distinct.algebra(F.col("a"), F.col("b"), 256).alias("e")).collect():
        x, y = ids[r.x], ids[r.y]
        for name, n in (("union", len(x | y)), ("both", len(x & y)), ("only_a", len(x - y))):
            assert abs(r.e["est_" + name] - n) <= r.e["err_" + name] + 1e-9 and r.e["est_" + name] >= 0
            if len(x | y) < 256:
                assert r.e["est_" + name] == n and r.e["err_" + name] == 0


def test_distinct_of_odd_tables(spark):
    kind = "client_id long, kind string, ts timestamp_ntz, member string, day long, name string"
    from datetime import datetime

    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [(1, "x", at(1)), (1, "x", at(1, 5)), (2, "y", at(2)), (None, "x", at(3)), (3, None, at(4)), (4, "x", None), (1, "y", at(9)), (1, "y", at(9))]
    table = spark.createDataFrame([(*r, "m", 5, "n") for r in rows], kind)
    options = {"member": "client_id", "name": "kind", "at": "ts"}
    got = {(r.day - 19722, r.kind_a, r.kind_b): (r.n_union, r.n_both, r.n_only_a) for r in distinct.overlaps(table, Scratch(spark, "t"), **options).collect()}
    assert set(got) == {(d, a, b) for d in (1, 2, 9) for a in "xy" for b in "xy"}
    assert got[1, "x", "x"] == (1, 0, 1) and got[2, "y", "x"] == (2, 0, 1) and got[2, "x", "x"] == (1, 1, 0) and got[9, "y", "y"] == (2, 0, 1) and got[9, "x", "x"] == (0, 0, 0)
    assert distinct.overlaps(table.where("false"), Scratch(spark, "t"), **options).collect() == []
