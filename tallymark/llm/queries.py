"""The training-data queries, name -> (spark, sf_dir) -> DataFrame, and their oracle SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontam, distinct, langid, licenses, lines, lm, maincontent, minhash, phrases, pieces, pivots, sharding
from .common import Scratch, crc_of_id, table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


MODEL = "piece_bpe_32k.model"


def op1_chat_format(spark, sf_dir):
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema))
    scratch, words = Scratch(spark, "chat"), (vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    back = chat.read_back(chat.build(rows, scratch, *words), *words)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_sentencepiece(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary(MODEL))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(crc_of_id(), F.lit(4)) == 2
    model = langid.fit(docs, ~held_out, pieces.codec(vocabulary(MODEL)).pieces)
    rows = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text")
    return langid.predict(rows, model, id_column="key").select("key.doc_id", "key.held_out", "lang_pred", "score")


def op4_sharding(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"), Scratch(spark, "sharding"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = pages.select(F.struct("page_id", "url").alias("key"), "html")
    texts = maincontent.main_text(rows, maincontent.fit(pages), id_column="key")
    return texts.select("key.page_id", "key.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark, sf_dir):
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "pivots"))


def op8_lm_scoring(spark, sf_dir):
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "lm")
    held_out = F.pmod(crc_of_id(), F.lit(5)) == 1
    model, counts = lm.fit(docs, ~held_out, vocabulary(MODEL), scratch)
    rows = docs.select(F.struct("doc_id", held_out.alias("held_out")).alias("key"), "text")
    scored = lm.score(rows, model, counts, scratch, id_column="key")
    return scored.select("key.doc_id", "key.held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "minhash"), width=3, hundredths=85)


def op11_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"), Scratch(spark, "phrases"))


def op12_line_dedup(spark, sf_dir):
    kept = lines.drop_repeated(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_distinct_sets(spark, sf_dir):
    return distinct.overlaps(table(spark, sf_dir, "clicks"), Scratch(spark, "distinct"), member="client_id", name="kind", at="ts")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_chat_format, op2_sentencepiece, op3_language_id, op4_sharding, op5_html_extraction, op6_license_scan, op7_embedding_dedup, op8_lm_scoring, op9_decontamination,
            op10_minhash, op11_collocations, op12_line_dedup, op13_distinct_sets,
        )
    }


# what the template of chat.py puts around and into texts, for DuckDB
_ESCAPED = r"regexp_replace(regexp_replace({0}, '(\\*)(<\|turn:|\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')"
_CHAT = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 c as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
  cast(sum(13 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) as bigint) as formatted_chars from t group by conv_id)
 select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from c"""

_REACHED = "r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), m as (select a, min(b) as b from r group by a)"
_VECTORS = f"""with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings),
 ok as (select * from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 l as (select x.vec_id as a, y.vec_id as b from ok x join ok y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9), {_REACHED},
 n as (select a, count(*) as n from l group by a)
 select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(m.b, vec_id)) as component_id, vec_id <= coalesce(m.b, vec_id) as kept from v left join m on m.a = vec_id left join n on n.a = vec_id"""

_SHINGLES = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
 d as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) end as s from w),
 s as (select doc_id, len(s) as n, unnest(s) as x from d),
 p as (select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as u, count(*) as i from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n),
 h as (select a, b from p where 100 * i >= 85 * u), l as (select a, b from h union all select b, a from h), {_REACHED}
 select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(m.b, doc_id)) as component_id, doc_id <= coalesce(m.b, doc_id) as kept from d left join m on m.a = doc_id"""


_COLLOCATIONS = """with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
 w as (select lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
 f as (select lang, k.k, array_to_string(w[i:i + k.k - 1], ' ') as gram, count(*) as a from (select lang, w, unnest(range(1, len(w) + 1)) as i from w) join (select unnest([1, 2, 3, 4]) as k) k on i + k.k - 1 <= len(w) group by all having count(*) >= 30),
 t as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
 c as (select lang, gram, k, a, string_split(gram, ' ') as w from f where k >= 2),
 u as (select lang, gram, a, w, unnest(range(1, k)) as k from c),
 s as (select u.lang, u.gram, u.a, u.k, x.a as l, y.a as r, cast(2000000 * cast(u.a as hugeint) // (cast(x.a as hugeint) + y.a) as bigint) as score from u join f x on x.lang = u.lang and x.gram = array_to_string(u.w[1:u.k], ' ') join f y on y.lang = u.lang and y.gram = array_to_string(u.w[u.k + 1:], ' ')),
 b as (select lang, gram, a, min({'score': score, 'k': k, 'l': l, 'r': r}) as m from s group by all),
 h as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' '), array_to_string(w[3:4], ' '), array_to_string(w[1:3], ' '), array_to_string(w[2:4], ' ')]) as gram, a from c where k = 4 union all select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]), a from c where k = 3),
 g as (select lang, gram, max(a) as most from h group by all),
 d as (select b.* from b left join g using (lang, gram) where g.most is null or 100 * cast(g.most as hugeint) < 80 * cast(b.a as hugeint)),
 q as (select lang, row_number() over (partition by lang order by m.score desc, a desc, gram) as rank, gram as phrase, a, m.l as l, m.r as r, n, m.score as score from d join t using (lang))
 select lang, rank, phrase, a, l, r, n, score from q where rank <= 2000"""

_LINES = """with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
 l as (select r, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
 k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
 f as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10)
 select doc_id, count(*) as n_lines, count(f.key) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
 from k left join f using (key) group by r, doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the queries whose whole result SQL can express; the tests hold the others against plain versions."""
    return {"op1_chat_format": _CHAT, "op7_embedding_dedup": _VECTORS, "op10_minhash": _SHINGLES, "op11_collocations": _COLLOCATIONS, "op12_line_dedup": _LINES}
