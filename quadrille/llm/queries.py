"""The operators of this subpackage as registered queries, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import language_id, lexical_packing, line_dedup, matroska, periodic_runs, phrase_index, quote_threads, ranked_search, sentence_pieces, simhash, substring_dedup, token_counts, toxicity
from quadrille.llm._spark import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quoting(talks: DataFrame) -> DataFrame:
    """The conversations as their authors would have sent them by mail: the table's messages quote nothing, so three of four
    turns get quotes in front: of the turn before, of the two turns before with an attribution line, or of the first line two turns before."""
    said = talks.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    back = lambda k: said.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("said").alias(f"said{k}"))
    rows = talks.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    quote = lambda c, mark: F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    own, k = F.coalesce("text", F.lit("")), F.col("turn") % 4
    made = F.when((k == 1) & F.col("said1").isNotNull(), F.concat(quote("said1", "> "), F.lit("\n"), own))
    made = made.when((k == 2) & F.col("said1").isNotNull() & F.col("said2").isNotNull(), F.concat(F.lit("On Monday, they wrote:\n"), quote("said2", "> > "), quote("said1", "> "), own))
    made = made.when((k == 3) & F.col("said2").isNotNull(), F.concat(F.lit("> "), F.split_part("said2", F.lit("\n"), F.lit(1)), F.lit("\n"), own))
    return rows.select("conv_id", "turn", "role", made.otherwise(F.col("text")).alias("text"))


def op8_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_threads.format_messages(quoting(table(spark, sf_dir, "conversations")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lexical_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def repeating(docs: DataFrame) -> DataFrame:
    """The texts with periods put in: in a tenth of them (by doc_id) the words from a place on go through the same few words again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    tenth = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # words only through functions of whole arrays: a function of each element would find all of them again for each
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return tenth.select("doc_id", F.when(n > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
                       F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_toxicity, op3_token_counts, op4_sentence_pieces, op5_media_columns,
        op6_decontamination, op7_simhash, op8_quote_threads, op9_language_id, op10_substring_dedup, op11_packing, op12_periodic_runs, op13_ranked_search)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

# the same quotes as `quoting` puts in front, said in SQL
_TALKS = """u AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), talks AS (SELECT c.conv_id, c.turn, c.role, CASE
WHEN c.turn % 4 = 1 AND a.text IS NOT NULL THEN '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || coalesce(c.text, '')
WHEN c.turn % 4 = 2 AND a.text IS NOT NULL AND b.text IS NOT NULL THEN 'On Monday, they wrote:' || chr(10) || '> > ' || replace(b.text, chr(10), chr(10) || '> > ') || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10) || coalesce(c.text, '')
WHEN c.turn % 4 = 3 AND b.text IS NOT NULL THEN '> ' || split_part(b.text, chr(10), 1) || chr(10) || coalesce(c.text, '') ELSE c.text END AS text
FROM conversations c LEFT JOIN u a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN u b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2)"""
ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents), i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
q AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s, w FROM i WHERE len(w) > 0), k AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS k FROM q),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, (SELECT DISTINCT n FROM k) m WHERE len(w) >= n), y AS (SELECT x.doc_id, x.s, x.n, k.item_id FROM x JOIN k ON x.n = k.n AND array_to_string(x.w[x.s : x.s + x.n - 1], ' ') = k.k),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM y) z GROUP BY 1), j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM y) z GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "op10_substring_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
y AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(w[s : s + 49], ' ')) AS first FROM x), g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS pos FROM y WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d), k AS (SELECT e.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY e.pos) AS text FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op13_ranked_search": f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS t FROM documents), d AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM w WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d), e AS (SELECT r, unnest(t) AS term FROM w), c AS (SELECT r, term, count(*) AS tf FROM e GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS t FROM benchmark), u AS (SELECT q, item_id, unnest(t) AS term FROM i), v AS (SELECT q, item_id, term, count(*) AS repeats FROM u GROUP BY 1, 2, 3),
g AS (SELECT v.q, v.item_id, c.r, repeats * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS gain FROM v JOIN f USING (term) JOIN c USING (term) JOIN d USING (r), s),
p AS (SELECT q, item_id, r, CAST(sum(gain) AS BIGINT) AS score FROM g GROUP BY 1, 2, 3 HAVING sum(gain) > 0), o AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS k FROM p JOIN d USING (r))
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM o WHERE k <= 10""",
    "op8_quote_threads": rf"""WITH RECURSIVE {_TALKS}, l AS (SELECT conv_id, turn, role, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS s, unnest(range(len(string_split_regex(coalesce(text, ''), '\r?\n')))) AS i FROM talks),
p AS (SELECT conv_id, turn, role, i, length(replace(regexp_extract(s, '{quote_threads.QUOTE}'), ' ', '')) AS level, regexp_replace(regexp_replace(s, '{quote_threads.QUOTE}', ''), '^ ', '') AS s FROM l),
c AS (SELECT *, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS opens FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)), g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i) AS part FROM c),
k AS (SELECT conv_id, turn, any_value(level) AS level, trim(regexp_replace(lower(string_agg(s, ' ' ORDER BY i)), '\s+', ' ', 'g')) AS body FROM g GROUP BY conv_id, turn, part UNION SELECT conv_id, turn, level, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) FROM p),
q AS (SELECT conv_id, turn, body, min(level) AS level FROM k WHERE level > 0 AND body <> '' GROUP BY 1, 2, 3), f AS (SELECT q.conv_id, q.turn, q.level, max(o.turn) AS found FROM q JOIN k o ON o.conv_id = q.conv_id AND o.body = q.body AND o.level = 0 AND o.turn < q.turn GROUP BY q.conv_id, q.turn, q.level, q.body),
r AS (SELECT conv_id, turn, -1 * min(struct_pack(a := level, b := -found)).b AS reply_to FROM f GROUP BY 1, 2), t AS (SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM r UNION ALL SELECT t.conv_id, t.turn, r.reply_to, t.depth + 1 FROM t JOIN r ON r.conv_id = t.conv_id AND r.turn = t.thread),
d AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM t GROUP BY 1, 2), n AS (SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (WHERE level > 0) AS n_quoted FROM p GROUP BY 1, 2),
e AS (SELECT p.conv_id, p.turn, regexp_replace(string_agg(s, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS clean FROM p JOIN n ON n.conv_id = p.conv_id AND n.turn = p.turn WHERE level = 0 AND NOT (n_quoted > 0 AND regexp_matches(s, '{quote_threads.ATTRIBUTION}')) GROUP BY 1, 2)
SELECT n.conv_id, n.turn, n.role, r.reply_to, coalesce(d.thread, n.turn) AS thread, CAST(coalesce(d.depth, 0) AS BIGINT) AS depth, n.n_quoted, '<|' || coalesce(n.role, '') || '|>' || chr(10) || coalesce(e.clean, '') || '<|end|>' AS formatted
FROM n LEFT JOIN r ON r.conv_id = n.conv_id AND r.turn = n.turn LEFT JOIN d ON d.conv_id = n.conv_id AND d.turn = n.turn LEFT JOIN e ON e.conv_id = n.conv_id AND e.turn = n.turn""",
}
