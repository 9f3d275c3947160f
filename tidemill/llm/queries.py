"""The operators of this folder as queries on the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, chat, decontamination, idfile, lines, neardup, packing, pii, repetition, tokencount, variants, whitening, wrappers
from tidemill.session import staging_root

Query = Callable[[SparkSession, str], DataFrame]

#: The contract of the near-duplicate query takes shingles of four words.
FOUR_WORDS = neardup.Similar(words=4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.records_of_turns(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    extra = spark.sql(
        """SELECT -1L AS conv_id, to_json(named_struct('messages', array(
             named_struct('role', 'user', 'content', '</s>[INST] ok [/INST]'),
             named_struct('role', 'assistant', 'content', '</s>[INST] ok [/INST]')))) AS record"""
    )
    return chat.summarise(chat.format_records(records.unionByName(extra), "conv_id", "record"), "conv_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(_table(spark, sf_dir, "documents"))
    # Spans come sorted by start, then kind as listed.
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in (*pii.KINDS, "term")]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id", *counts[:-1], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        counts[-1],
        F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.mark(_table(spark, sf_dir, "documents"), rule=FOUR_WORDS)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), digest.alias("text_sha256"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging_root(spark)}/tidemill/ids-{uuid.uuid4().hex}"
    idfile.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return idfile.read_ids(spark, path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    parts = [F.struct(F.lit(i + 1).alias("component"), F.get("whitened", F.lit(i)).alias("whitened"), F.lit(float(x)).alias("explained")) for i, x in enumerate(model.explained())]
    rows = whitening.transform(vectors, model)
    parts = F.array(*parts) if parts else F.expr("CAST(array() AS ARRAY<STRUCT<component: INT, whitened: DOUBLE, explained: DOUBLE>>)")
    rows = rows.select("vec_id", "deviation", F.explode(parts).alias("x"))
    return rows.select(
        "vec_id", "x.component", F.lit(model.n).cast("long").alias("n"), "deviation", "x.whitened", "x.explained",
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The contract of the spelling query takes a character from one run in 199.
MISSPELT = variants.Spelling(misspelt=199)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.count_words(_table(spark, sf_dir, "documents"), rule=MISSPELT), MISSPELT)


def queries() -> dict[str, Query]:
    named = (
        op1_chat_formatting, op2_pii, op3_html_extraction, op4_near_duplicates, op5_byte_bpe, op6_decontamination,
        op7_line_dedup, op8_repetition, op9_token_ids, op10_token_counts, op11_whitening, op12_packing,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in named}


_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(text, '\x1A|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '..', 'g') AS guarded FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(guarded) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

_OP3 = r"""
WITH body AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS x FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '<b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM body),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM bare),
done AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM done
"""

_OP4 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(w[i:i+3], 'string_agg', ' ') END AS s
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [1] ELSE range(1, len(w) - 2) END) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(low.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""

_OP6 = r"""
WITH lists AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM lists),
items AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS k, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS s
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)),
windows AS (
  SELECT id AS doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(w) >= k)),
found AS (SELECT doc_id, i, windows.k, item_id FROM windows JOIN items ON windows.s = items.s AND windows.k = items.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits ON hits.doc_id = words.id LEFT JOIN named ON named.doc_id = words.id WHERE side = 'd'
"""

_OP7 = r"""
WITH lines AS (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
common AS (SELECT line FROM lines WHERE trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
marked AS (SELECT lines.*, common.line IS NOT NULL AS hit FROM lines LEFT JOIN common ON lines.line = common.line),
whole AS (SELECT doc_id, count(*) AS n, bool_or(NOT hit AND trim(line, ' ') <> '') AS own FROM marked GROUP BY doc_id),
done AS (
  SELECT marked.doc_id, any_value(n) AS n_lines, CAST(sum(CASE WHEN hit AND own THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
    coalesce(string_agg(CASE WHEN hit AND own THEN NULL ELSE line END, chr(10) ORDER BY place), '') AS text
  FROM marked JOIN whole ON whole.doc_id = marked.doc_id GROUP BY marked.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(done.text) AS n_chars, sha256(done.text) AS text_sha256
FROM documents d LEFT JOIN done ON done.doc_id = d.doc_id
"""

_OP13 = r"""
WITH RECURSIVE steps(i, k, x) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM steps WHERE k < 8),
bytes AS (SELECT list(x ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
held AS (SELECT doc_id, run, count(*) AS m, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY ALL),
checked AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
    lambda h, b: xor(h // 256, t[1 + xor(h % 256, b)])), 4294967295) AS h FROM held, bytes),
cut AS (SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
marked AS (SELECT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS masked FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS less FROM places),
ends AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM marked a JOIN marked b ON a.masked = b.masked AND a.word <> b.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.less = b.word
  UNION ALL SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.less = b.word),
near AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top FROM ends GROUP BY word),
forms AS (
  SELECT near.word, min(other) AS form, any_value(top) AS form_n FROM near JOIN ends ON ends.word = near.word AND other_n = top AND top >= 5 * near.n
  GROUP BY near.word),
chain(word, ending, k) AS (
  SELECT word, form, 1 FROM forms UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN forms ON forms.word = chain.ending),
tops AS (SELECT word, arg_max(ending, k) AS root FROM chain GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN near ON near.word = words.word LEFT JOIN forms ON forms.word = words.word LEFT JOIN tops ON tops.word = words.word
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": _OP1, "op3_html_extraction": _OP3, "op4_near_duplicates": _OP4, "op6_decontamination": _OP6, "op7_line_dedup": _OP7,
        "op13_spelling_variants": _OP13,
    }
