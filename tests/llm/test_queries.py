"""The registered queries as they are: digests, flags and counts against SQL or plain versions."""

import hashlib
import zlib

import duckdb
import pytest

pytest.importorskip("tallymark.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tallymark.llm import maincontent, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations pages clicks benchmark".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(map(tuple, df.select(columns).collect()), key=str)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_codec_query(spark, duck):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for doc, text in duck.sql("select doc_id, coalesce(text, '') from documents").fetchall():
        ids = sp.encode(text, add_eos=True)
        want[doc] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_sentencepiece(spark, SF).collect()}
    assert got == want


def test_language_query(spark, duck):
    rows = {r.doc_id: r for r in queries.op3_language_id(spark, SF).collect()}
    labelled = duck.sql("select doc_id, lang from documents").fetchall()
    assert set(rows) == {d for d, _ in labelled}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(lang, rows[d].lang_pred) for d, lang in labelled if lang and rows[d].held_out and rows[d].lang_pred != "und"]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0


def test_sharding_query(spark, duck):
    rows = queries.op4_sharding(spark, SF).collect()
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    size = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 40
        size.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in size.values())


def test_page_query(spark, duck):
    import html
    import re

    want = {}
    for page, url, source in duck.sql("select page_id, url, html from pages").fetchall():
        article = re.search("<article>(.*?)</article>", source or "", re.S)
        parts = re.split("</?(?:p|h1)>", article[1] if article else "")
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " " if x.startswith("<br") else "", x)).split()) for x in (re.sub("<br>", "\n", p) for p in parts)]
        want[page, url] = "\n\n".join(x for x in parts if x)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in queries.op5_html_extraction(spark, SF).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert maincontent.ADJACENT > 0


def test_score_query(spark, duck):
    rows = {r.doc_id: r for r in queries.op8_lm_scoring(spark, SF).collect()}
    want = duck.sql("""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') || ['']) as w from documents),
     ids as (select doc_id from documents) select doc_id, w, count(*) as n from t group by all""").fetchall()
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in rows}
    counts = {}
    for d, w, n in want:
        counts[w] = counts.get(w, 0) + (0 if held[d] else n)
    counts = {w: n for w, n in counts.items() if n}
    import math

    total, distinct = sum(counts.values()), len(counts)
    plain = {}
    for d, w, n in want:
        x = plain.setdefault(d, [0, 0, 0.0])
        x[0], x[1] = x[0] + n, x[1] + (n if w in counts else 0)
        x[2] += n * math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1)))
    for d, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], plain[d][0], plain[d][1], total)
        assert r.base_score == pytest.approx(plain[d][2]) and r.score < 0


def test_distinct_query(spark, duck):
    got = {(r.day, r.kind_a, r.kind_b): r for r in queries.op13_distinct_sets(spark, SF).collect()}
    used = duck.sql("select distinct client_id, kind, date_diff('day', date '1970-01-01', ts::date) from clicks where client_id is not null and kind is not null and ts is not null").fetchall()
    kinds = {k for _, k, _ in used}
    at = {}
    for c, k, d in used:
        at.setdefault((k, d), set()).add(c)
    days = {d for _, _, d in used}
    assert set(got) == {(d, a, b) for d in days for a in kinds for b in kinds}
    for (d, a, b), r in got.items():
        x = set().union(*(at.get((a, d - i), ()) for i in range(7)))
        y = set().union(*(at.get((b, d - 1 - i), ()) for i in range(7)))
        assert (r.n_union, r.n_both, r.n_only_a) == (len(x | y), len(x & y), len(x - y))
        for name, n in (("union", len(x | y)), ("both", len(x & y)), ("only_a", len(x - y))):
            assert abs(r["est_" + name] - n) <= r["err_" + name] <= 8 * r.est_union / 512**0.5 + 3


def words_of(text):
    import re

    return [w for w in re.split(r"[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_leak_query(spark, duck):
    """Every item against every document: four fifths of an item's shingles within a stretch of the document."""
    items = {i: words_of(t) for i, t in duck.sql("select item_id, text from benchmark").fetchall() if words_of(t)}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    longest = max(map(len, items.values()))
    want = set()
    for doc, text in duck.sql("select doc_id, text from documents").fetchall():
        words = words_of(text)
        stretches = [words[k : k + 2 * longest] for k in range(0, max(1, len(words)), longest)]
        for i, item in items.items():
            n = min(5, len(item))
            if any(len(grams(item, n) & grams(part, n)) >= 0.8 * len(grams(item, n)) - 1e-9 for part in stretches if len(part) >= n):
                want.add((doc, i))
    got = {(r.doc_id, r.item_id) for r in queries.op9_decontamination(spark, SF).collect()}
    assert got == want and want


def test_license_query(spark, duck):
    """Rows of documents in which a short notice stands as it is."""
    from tallymark.llm import licenses

    notices = {name: texts[0] for name, texts in licenses.TEMPLATES.items() if len(texts[0].split()) < 20}
    got = {}
    for r in queries.op6_license_scan(spark, SF).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
        assert 0.8 <= r.coverage <= 1 and 0 <= r.first_char < r.end_char
    texts = dict(duck.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    held = {(d, name) for d, t in texts.items() for name, notice in notices.items() if " ".join(notice.split()).lower() in " ".join(t.split()).lower()}
    assert held and all(name in got.get(d, ()) for d, name in held)
    plain = {d for d, t in texts.items() if "licen" not in t.lower()}
    assert not plain & set(got)
