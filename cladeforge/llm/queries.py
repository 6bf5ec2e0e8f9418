"""Thin queries of the corpus operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm import decontam, fim, langid, lines, lm, minhash, quality, resample, rules, spm, tokens, urls, warc
from cladeforge.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links from 85 per cent on."""
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, width=3, percent=85, rows=8).withColumnRenamed("id", "doc_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with a tenth of the merges dropped, and decoded: pieces, a digest of the ids, whether equal."""
    path = spm.tokenizer_path()
    encoded = spm.encode_documents(table(spark, sf_dir, "documents"), path, dropout=0.1, seed=1)
    decoded = spm.decode_documents(encoded, path, ["id", "text"])
    return decoded.select(F.col("id").alias("doc_id"), F.coalesce(F.size(F.when(F.col("ids").isNotNull(), F.col("ids"))), F.lit(0)).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark), keep=["page_id"])


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text before and after three keyed edits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokens.keyed_edits().alias("edits"))
    return tokens.count_edited(docs, spm.tokenizer_path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs)).withColumnRenamed("id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read_back(warc.write_archives(pages))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("clean_text")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go, and a digest of what stays."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_digest"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark: single words, 10,000 buckets."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts with prefix, middle and suffix rearranged, and digests of output and restored text."""
    out = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_sentencepiece, op3_urls, op4_tokens, op5_decontaminate, op6_lm, op7_quality, op8_warc, op9_rules, op10_lines, op11_resampling, op12_fim, op13_langid)
}

ORACLE: dict[str, str] = {
    "op1_minhash": """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
  sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) end as s from w),
  rows as materialized (select doc_id, len(s) as n, unnest(s) as piece from sets),
  links as materialized (select a.doc_id as a, b.doc_id as b from rows a join rows b on a.piece = b.piece and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  reach(id, root) as (select doc_id, doc_id from documents union select l.b, r.root from reach r join links l on l.a = r.id),
  label as (select id, min(root) as component_id from reach group by id)
  select doc_id, len(s)::bigint as n_shingles, component_id, component_id = doc_id as kept from sets join label on id = doc_id""",
    "op8_warc": """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
  bits as (select page_id, html, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(h, i, 1))::integer), 4, '0')), '') as b from p),
  d as (select page_id, strlen(html)::bigint as payload_bytes, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(1, 6), lambda j: substr(b, 5 * i + j, 1)::integer), lambda x, y: 2 * x + y), 1)), '') as payload_digest from bits),
  m as (select *, max(page_id) over (partition by html) as first_id from d)
  select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type, case when page_id <> first_id then first_id end as refers_to from m""",
    "op3_urls": """with rules(action, r_host, r_path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
  p as (select row_number() over () as k, page_id, coalesce(translate(regexp_extract(url, '^(?:.|\\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?:.|\\n)*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
  m as (select k, r_host || r_path as rule, action, row_number() over (partition by k order by len(r_host || r_path) desc, len(r_host) desc, action) as rn
    from p join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
  select page_id, host, path, rule, coalesce(action, 'allow') as verdict from p left join m on m.k = p.k and m.rn = 1""",
    "op11_resampling": """with recursive crc(i, step, c) as (select range, 0, range from range(256) union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where step < 8),
  crc_table as (select list(c order by i) as t from crc where step = 8),
  dw as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
  bw as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
  du as (select k, unnest(ws) as w from dw), bu as (select unnest(ws) as w from bw),
  words as materialized (select w, hex(encode(w)) as h from (select w from du union select w from bu)),
  buckets as materialized (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as b from words, crc_table),
  s as (select b, count(*) as s from du join buckets using (w) group by b), t as (select b, count(*) as t from bu join buckets using (w) group by b),
  tot as (select (select count(*) from du) as sa, (select count(*) from bu) as ta),
  gains as (select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * (sa + 10000) / ((coalesce(s, 0) + 1)::double * (ta + 10000))))::bigint as g from s full join t using (b), tot),
  sums as (select k, sum(g) as g from du join buckets using (w) join gains using (b) group by k),
  scored as (select k, doc_id, len(ws)::bigint as n_features, case when len(ws) = 0 then 0 else floor(g::double / len(ws))::bigint end as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
    from dw left join sums using (k)),
  drawn as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored),
  ranked as (select k, row_number() over (order by score desc, doc_id) as r from drawn where n_features >= 20)
  select doc_id, n_features, weight, score, case when r <= (select count(*) * 10 // 100 from ranked) then r end as rank from drawn left join ranked using (k)""",
    "op12_fim": """with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || doc_id) as h from documents),
  u as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tok, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
  c as (select *, len(tok)::bigint as n, least(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as a, greatest(h1 % (len(tok) + 1), h2 % (len(tok) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
  x as (select *, array_to_string(tok[1:a], '') as p, array_to_string(tok[a + 1:b], '') as m, array_to_string(tok[b + 1:], '') as s from c)
  select doc_id, n, form, case when form <> 'plain' then len(p) end as prefix_chars, case when form <> 'plain' then len(m) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from x""",
}
