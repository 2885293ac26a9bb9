"""One query per operator, over whole tables, each beside its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomark.llm import bpe, decontaminate, fill_middle, filter_audit, html_text, near_dup, ngram_join, quality, substrings, token_store, tool_calls, topk, toxicity
from fathomark.plans.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# White space of the word rules: \x20 and \x09-\x0D.
SQL_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query(
    "op2_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
    windows AS (
      SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    firsts AS (SELECT win, min(doc_id) AS f FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (win), (SELECT unnest(range(0, 13)) AS k) WHERE doc_id > f),
    gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
    kept AS (
      SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
             CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS k
      FROM d LEFT JOIN gone USING (doc_id))
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """,
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), as_digest=True)
    return out.withColumnRenamed("kept", "kept_sha256")


SQL_LOWER_WORDS = SQL_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
SQL_SHINGLES = f"""
    words AS (SELECT doc_id, {SQL_LOWER_WORDS} AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words)
"""


@query(
    "op1_minhash_near_dedup",
    f"""
    WITH RECURSIVE {SQL_SHINGLES},
    classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS k, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
    member AS (SELECT doc_id, rep FROM sets JOIN classes ON list_sort(sets.s) = classes.k),
    grams AS (SELECT rep, unnest(s) AS g FROM classes),
    often AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
    links AS (
      SELECT u, v FROM often JOIN classes x ON x.rep = u JOIN classes y ON y.rep = v
      WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
    both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach(n, m) AS (SELECT rep, rep FROM classes UNION SELECT reach.n, both_ways.v FROM reach JOIN both_ways ON reach.m = both_ways.u),
    least AS (SELECT n AS rep, min(m) AS c FROM reach GROUP BY n)
    SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
    FROM sets d LEFT JOIN member USING (doc_id) LEFT JOIN least USING (rep)
    """,
)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL_TOKENS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
SQL_HITS = f"""
    bw AS (SELECT item_id, {SQL_TOKENS} AS w FROM benchmark),
    dw AS (SELECT doc_id, {SQL_TOKENS} AS w FROM docs),
    bwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
    lens AS (SELECT DISTINCT n FROM bwin),
    dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item_id, i, dwin.n FROM dwin JOIN bwin ON dwin.win = bwin.win AND dwin.n = bwin.n),
    places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
"""


@query(
    "op5_decontaminate",
    f"""
    WITH docs AS (SELECT * FROM documents), {SQL_HITS}
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True, digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query("op8_token_store")
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(
    "op6_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op10_tool_calls",
    """
    WITH t AS (
      SELECT conv_id, turn, (min({'r': coalesce(role, ''), 't': coalesce(text, '')})).r AS role, (min({'r': coalesce(role, ''), 't': coalesce(text, '')})).t AS text
      FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
    asked AS (SELECT conv_id, turn, text, string_split(text, chr(10)) AS ls FROM t WHERE role <> 'assistant'),
    calls AS (
      SELECT conv_id, turn, k - 1 AS place, 'call-' || conv_id || '-' || turn || '-' || k AS call_id,
             to_json({'text': ls[k], 'turn': turn})::VARCHAR AS arguments, 'note' AS name
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM asked)
      UNION ALL
      SELECT conv_id, turn, len(ls), 'call-' || conv_id || '-' || turn || '-0', to_json({'lines': len(ls), 'text': text, 'turn': turn})::VARCHAR, 'answer' FROM asked),
    answers AS (SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) || '-0' AS call_id, text FROM t WHERE role = 'assistant'),
    both_sides AS (
      SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.turn) AS turn, coalesce(c.place, 0)::INT AS place, coalesce(c.call_id, a.call_id) AS call_id,
             CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, c.call_id IS NOT NULL AS in_order,
             c.arguments, c.name, a.text AS result
      FROM calls c FULL OUTER JOIN answers a ON c.conv_id = a.conv_id AND c.call_id = a.call_id)
    SELECT conv_id, turn, place, call_id, status, in_order, 0::BIGINT AS n_faults,
           sha256('{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || coalesce('"' || name || '"', 'null')
             || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"status":"' || status || '","valid":true}') AS json_sha256
    FROM both_sides
    """,
)
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, results = tool_calls.calls_of_turns(table(spark, sf_dir, "conversations"))
    out = tool_calls.link(messages, results, tool_calls.SCHEMAS)
    return out.select("conv_id", "turn", "place", "call_id", "status", "in_order", F.size("faults").cast("long").alias("n_faults"), F.sha2(F.col("json"), 256).alias("json_sha256"))


@query(
    "op11_fill_middle",
    """
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h
      FROM documents),
    n AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    f AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR coalesce(h3 % 100 >= 50, true) THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM n),
    parts AS (
      SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM f)
    SELECT doc_id, n::BIGINT AS n, form,
      CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    texts = (F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *texts)


@query(
    "op12_filter_audit",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {SQL_WORDS} AS w FROM documents),
    flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    bits AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS c
      FROM d LEFT JOIN flags USING (doc_id)),
    counts AS (SELECT part, c, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY ALL),
    orders(o) AS (
      SELECT '' UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE length(o) < 5 AND NOT contains(o, l)),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
    steps AS (
      SELECT o, k AS step, bit, coalesce((SELECT sum(x.bit) FROM letters x WHERE contains(o[1:k - 1], x.l)), 0)::INT AS before
      FROM orders, (SELECT unnest(range(1, 6)) AS k), letters WHERE length(o) = 5 AND o[k] = l),
    out AS (
      SELECT part, o, step, bit,
        sum(CASE WHEN c & bit = 0 AND c & before = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN c & bit <> 0 AND c & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN c & bit <> 0 AND c & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN c = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN c & bit <> 0 AND c & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN c & bit <> 0 AND c & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM counts, steps GROUP BY ALL),
    shares AS (SELECT part, bit, sum(removed) AS shapley FROM out GROUP BY ALL)
    SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
      unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
    FROM out JOIN shares USING (part, bit)
    """,
)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_ngram_jaccard",
    f"""
    WITH RECURSIVE words AS (SELECT doc_id, {SQL_LOWER_WORDS} AS w FROM documents),
    sets AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
    classes AS (SELECT min(doc_id) AS rep, list_sort(s) AS k, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
    member AS (SELECT doc_id, rep FROM sets JOIN classes ON list_sort(sets.s) = classes.k),
    grams AS (SELECT rep, unnest(s) AS g FROM classes),
    df AS (SELECT g, count(*) AS f FROM grams GROUP BY g),
    ranked AS (SELECT rep, g, row_number() OVER (PARTITION BY rep ORDER BY f, g) AS r FROM grams JOIN df USING (g)),
    heads AS (SELECT rep, g FROM ranked JOIN classes USING (rep) WHERE r <= len(s) - ceil(0.9 * len(s)) + 1),
    pairs AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM heads a JOIN heads b ON a.g = b.g AND a.rep < b.rep),
    counted AS (SELECT u, v, len(x.s) AS nx, len(y.s) AS ny, len(list_intersect(x.s, y.s)) AS c FROM pairs JOIN classes x ON x.rep = u JOIN classes y ON y.rep = v),
    links AS (SELECT u, v FROM counted WHERE 100 * c >= 90 * (nx + ny - c)),
    both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach(n, m) AS (SELECT rep, rep FROM classes UNION SELECT reach.n, both_ways.v FROM reach JOIN both_ways ON reach.m = both_ways.u),
    least AS (SELECT n AS rep, min(m) AS c FROM reach GROUP BY n)
    SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id
    FROM sets d LEFT JOIN member USING (doc_id) LEFT JOIN least USING (rep)
    """,
)
def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
