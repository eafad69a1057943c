"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import alignment, chat, decontamination, html_text, katz, mixing, near_duplicates, quality_rules, sharding, token_files, toxicity, warc, whitening
from .common import parked, table
from .registry import query

OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (
  SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
lv AS (
  SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS it,
         length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS vis,
         length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) AS sym,
         length(regexp_replace(l, '[^|»›•·→]+', '', 'g')) AS sep FROM ln),
lc AS (
  SELECT doc_id, l, vis, len(it) AS n, CASE
    WHEN len(it) = 0 THEN 0
    WHEN sym * 100 > vis * 10 THEN CASE WHEN sep * 3 >= len(it) THEN 2 ELSE 4 END
    WHEN len(it) >= 5 AND NOT regexp_matches(l, '\p{Ll}') AND regexp_matches(l, '\p{Lu}') THEN 4
    WHEN sep >= 2 AND sep * 4 >= len(it) THEN 2
    WHEN regexp_matches(lower(l), '(^|[\x20\x09-\x0D])(__BOILER__)') THEN 3
    WHEN NOT regexp_matches(l, '[.!?…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)') THEN 1
    ELSE 0 END AS code FROM lv),
la AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines,
         count(*) FILTER (code = 1) AS lines_punctuation, count(*) FILTER (code = 2) AS lines_navigation,
         count(*) FILTER (code = 3) AS lines_boilerplate, count(*) FILTER (code = 4) AS lines_noise,
         coalesce(sum(vis) FILTER (code > 0), 0)::BIGINT AS lost_chars FROM lc GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, lines_punctuation, lines_navigation, lines_boilerplate, lines_noise, lost_chars
  FROM w JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * 30 AS kept FROM b
""".replace("__BOILER__", quality_rules.BOILERPLATE)


@query("op2_quality_rules", OP2_SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.verdicts(docs).drop("text")


@query("op7_ring_sharding")
def op7_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.assign(docs, "doc_id", sharding.Ring(shards=16, nodes=64, cell_bits=14))
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op9_chat_formatting")
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    messages = chat.fold(chat.as_events(rows.unionByName(control)))
    return chat.summarise(parked(chat.render(messages), "chat"))


@query("op8_warc_archives")
def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_records(index, folder, keep_payload=False).drop("payload", "url")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_dir(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest, folder)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (
  SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
bs AS (
  SELECT item_id, len(w) AS l, p, array_to_string(w[p + 1 : p + 5], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS p FROM b WHERE len(w) >= 5)),
win AS (SELECT DISTINCT doc_id, item_id, l, greatest(ds.p - bs.p, 0) AS start FROM ds JOIN bs USING (s)),
wc AS (
  SELECT win.doc_id, win.item_id, win.start, ds.s, count(*) AS c
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p BETWEEN win.start AND win.start + win.l - 5 GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
na AS (SELECT doc_id, item_id, start, sum(c) AS n FROM wc GROUP BY ALL),
nb AS (SELECT item_id, sum(c) AS n FROM ic GROUP BY ALL),
com AS (SELECT doc_id, item_id, start, sum(least(wc.c, ic.c)) AS n FROM wc JOIN ic USING (item_id, s) GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, start, com.n::DOUBLE / (na.n + nb.n - com.n) AS similarity
  FROM com JOIN na USING (doc_id, item_id, start) JOIN nb USING (item_id)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::INTEGER AS start, similarity FROM best WHERE rn = 1
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "similarity")


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Target weights of the production mix; a domain is a group of sources.
MIX = {
    "domain": {"d0": 3.0, "d1": 2.0, "d2": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {"src0": 2.0},
}


def mix_plan(share: float) -> mixing.Plan:
    return mixing.Plan(levels=("domain", "lang", "source"), weights=MIX, share=share, epochs=2, seed=7)


def with_domain(docs: DataFrame) -> DataFrame:
    """Adds the domain of a document: the number at the end of its source, modulo 3; sources without one are d0."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.concat(F.lit("d"), (F.when(number == "", "0").otherwise(number).cast("int") % 3).cast("string")))


OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, text, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         'd' || (CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' THEN 0
                      ELSE regexp_extract(source, '([0-9]{1,9})$', 1)::INTEGER END % 3)::VARCHAR AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS supply FROM rows GROUP BY ALL),
n1 AS (
  SELECT domain, sum(supply)::BIGINT AS supply, CASE domain WHEN 'd0' THEN 3.0 WHEN 'd1' THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
         (SELECT floor(sum(tokens) * 0.6::DOUBLE + 1e-6)::BIGINT FROM leaf) AS above FROM leaf GROUP BY ALL),
__P1__,
n2 AS (
  SELECT l.domain, lang, l.supply, CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, budget AS above
  FROM (SELECT domain, lang, sum(supply)::BIGINT AS supply FROM leaf GROUP BY ALL) l JOIN p1 USING (domain)),
__P2__,
n3 AS (
  SELECT domain, lang, source, leaf.supply, CASE source WHEN 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE AS w, budget AS above
  FROM leaf JOIN p2 USING (domain, lang)),
__P3__,
goal AS (
  SELECT domain, lang, source, (budget // tokens)::INTEGER AS fulls, budget % tokens AS rest
  FROM p3 JOIN leaf USING (domain, lang, source)),
placed AS (
  SELECT rows.*, fulls, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('7:' || fulls || ':' || doc_id), text ROWS UNBOUNDED PRECEDING) AS so_far
  FROM rows JOIN goal USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(fulls + (so_far <= rest)::INTEGER))::INTEGER AS epoch FROM placed
"""


def _pour_sql(i: int, parent: str, path: str) -> str:
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
o{i} AS (
  SELECT *, coalesce(sum(supply) OVER ({over} ORDER BY supply / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
         sum(w) OVER ({over}) - coalesce(sum(w) OVER ({over} ORDER BY supply / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS restw
  FROM n{i}),
l{i} AS (SELECT *, (above - done)::DOUBLE / restw AS lev FROM o{i}),
f{i} AS (SELECT *, supply <= lev * w + 1e-6 AS filled FROM l{i}),
p{i} AS (
  SELECT {path}, CASE WHEN filled THEN supply
    ELSE floor((first_value(lev) OVER ({over} ORDER BY filled, supply / w, {path})) * w + 1e-6)::BIGINT END AS budget FROM f{i})"""


OP10_SQL = (
    OP10_SQL.replace("__P1__", _pour_sql(1, "", "domain"))
    .replace("__P2__", _pour_sql(2, "domain", "domain, lang"))
    .replace("__P3__", _pour_sql(3, "domain, lang", "domain, lang, source"))
)


@query("op10_source_mixing", OP10_SQL)
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    out = mixing.select(docs, mix_plan(0.6))
    own = [F.coalesce(F.col("doc")[c], F.lit(mixing.NONE)).alias(c) for c in ("domain", "lang", "source")]
    return out.select(F.col("doc.doc_id").alias("doc_id"), *own, "n_tokens", "epoch")


@query("op5_katz_scores")
def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages))


@query("op11_whitened_embeddings")
def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(remainder != 1).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs.where("NOT held_out"), labels))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
