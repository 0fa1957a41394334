"""Each stage of the pipeline, on what its predecessor kept, against a plain version."""

import hashlib
import re

import pytest

pytest.importorskip("tallymark.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
sentencepiece = pytest.importorskip("sentencepiece")

from pyspark.sql import functions as F  # noqa: E402

from tallymark.llm import langid, pieces, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in re.split(r"[ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def grams(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage, and those that come out of the last."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append({r.doc_id: r.text for r in docs.collect()})
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, {r.doc_id: r for r in docs.collect()}]


def test_language_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, F.lit(True), pieces.codec(queries.vocabulary(queries.MODEL)).pieces)
    said = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert set(stages[1]) == {d for d, r in said.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert all(stages[1][d] == stages[0][d] for d in stages[1]) and len(stages[1]) > 0.9 * len(stages[0])


def test_near_copies_stage(stages):
    sets = {d: grams(words_of(t)) for d, t in stages[1].items()}
    group = {d: d for d in sets}

    def top(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                i, j = sorted((top(a), top(b)))
                group[j] = i
    assert set(stages[2]) == {d for d in ids if top(d) == d} and len(stages[2]) < len(ids)


def test_leaks_stage(spark, stages):
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := words_of(r.text))]
    longest = max(map(len, items))
    held = set()
    for doc, text in stages[2].items():
        words = words_of(text)
        parts = [grams(words[k : k + 2 * longest]) for k in range(0, max(1, len(words)), longest)]
        if any(len(want & part) >= 0.8 * len(want) - 1e-9 for want in map(grams, items) for part in parts):
            held.add(doc)
    assert set(stages[3]) == set(stages[2]) - held and held


def test_ids_stage(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary(queries.MODEL))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(stages[4]) == set(stages[3])
    for doc, r in stages[4].items():
        ids = sp.encode(stages[3][doc] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
