"""Text, chunks, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import chunking, retrieval
from .registry import query, table

WORDS = ["the", "tion", "und"]
COUNT_SQL = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in WORDS)


@query(f"WITH s AS (SELECT doc_id, {COUNT_SQL} AS score FROM documents) SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 8")
def keyword_topk(spark, sf_dir):
    return retrieval.keyword_topk(table(spark, sf_dir, "documents"), "doc_id", "text", WORDS)


CLEAN = "list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"WITH l AS (SELECT doc_id, {CLEAN} AS l FROM documents), k AS (SELECT doc_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS k FROM l) SELECT doc_id, len(k)::INT AS n_lines, sha256(array_to_string(k, chr(10))) AS sha FROM k")
def consecutive_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chunking.without_repeats(chunking.lines("text")).alias("k"))
    return rows.select("doc_id", F.size("k").alias("n_lines"), F.sha2(F.array_join("k", "\n"), 256).alias("sha"))


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, {CLEAN} AS l FROM documents),
p(doc_id, i, part, used) AS (SELECT doc_id, 1, 1, length(l[1]) + 1 FROM l WHERE len(l) > 0
  UNION ALL SELECT p.doc_id, i + 1, CASE WHEN used + length(l[i + 1]) + 1 > 600 THEN part + 1 ELSE part END, CASE WHEN used + length(l[i + 1]) + 1 > 600 THEN length(l[i + 1]) + 1 ELSE used + length(l[i + 1]) + 1 END FROM p JOIN l ON p.doc_id = l.doc_id WHERE i < len(l))
SELECT p.doc_id, part, count(*)::INT AS n_lines, sha256(string_agg(l.l[i], chr(10) ORDER BY i)) AS sha FROM p JOIN l ON p.doc_id = l.doc_id GROUP BY ALL
""")
def chunk_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", chunking.lines("text").alias("l"))
    return chunking.parts(rows, "l", 600, ["doc_id"]).select("doc_id", "part", "n_lines", F.sha2("content", 256).alias("sha"))


@query(f"""
WITH l AS (SELECT doc_id, source, unnest({CLEAN}) AS line, generate_subscripts({CLEAN}, 1) AS i FROM documents)
SELECT doc_id, count(*) AS n_lines, sum(length('[SOURCE_PAGE: ' || doc_id || '; path=' || source || '] ' || line))::BIGINT AS chars FROM l GROUP BY 1
""")
def provenance_chunks(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page"), "source", chunking.lines("text").alias("texts"))
    out = chunking.provenance(pages, "page", "source", "texts", 20_000)
    body = F.expr("regexp_replace(section, '(?s)^[^\\n]*\\n\\n|\\n$', '')")
    lines = out.select("page", F.explode(F.split(body, "\n")).alias("line"))
    return lines.groupBy(F.col("page").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("chars"))


SAID = ["Скважины площадей и ёлками, отчёт: структурами 12-а", "КАК залежью нефтяного месторождения между пластов", "Ёмкость по-новому; Для или горизонтами, его"]
STOPS = ", ".join(f"'{w.replace('ё', 'е')}'" for w in T.STOPWORDS)
SPOKEN_SQL = "text || ' ' || CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAID)) + " END"
TOKEN_SQL = f"list_filter(list_transform(regexp_extract_all({SPOKEN_SQL}, '[0-9A-Za-zА-Яа-яЁё-]{{2,}}'), lambda x: translate(lower(x), 'ё', 'е')), lambda x: x NOT IN ({STOPS}))"
STEM_SQL = f"CASE WHEN regexp_full_match(token, '[а-я-]+') THEN regexp_replace(token, '^(.{{4,}}?)({'|'.join(T.ENDINGS)})$', '\\1') ELSE token END"


@query(f"WITH t AS (SELECT unnest({TOKEN_SQL}) AS token FROM documents) SELECT {STEM_SQL} AS token, count(*) AS n FROM t GROUP BY 1")
def tokens_stem(spark, sf_dir):
    """Words of the documents, each followed by a Russian phrase."""
    spoken = F.concat("text", F.lit(" "), F.get(F.lit(SAID), (F.col("doc_id") % 3).cast("int")))
    return table(spark, sf_dir, "documents").select(F.explode(T.tokens(spoken)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '1' || p_size || '0,5 ОТ' ELSE 'T'|| '' || 'от ' || p_size || '-01' END AS fixed FROM part")
def numeric_confusable(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("І"), F.col("p_size").cast("string"), F.lit("О,5 ОТ"))).otherwise(F.concat(F.lit("Tот "), F.col("p_size").cast("string"), F.lit("-оТ")))
    return table(spark, sf_dir, "part").select("p_partkey", T.numeric_ocr(raw).alias("fixed"))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, least(1.0, greatest(0.0, json_extract_string(props, '$.k')::DOUBLE / 50)) AS confidence FROM events""")
def json_items(spark, sf_dir):
    v = F.try_variant_get(T.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", v.alias("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 50)).alias("confidence"))


@query("""
WITH t AS (SELECT role, text, lead(role) OVER w AS r2, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT lower(trim(text)) AS q, min(a) AS a FROM t WHERE role = 'user' AND r2 = 'assistant' GROUP BY 1)
SELECT conv_id, turn, sha256(coalesce(a, '')) AS answer_sha FROM conversations LEFT JOIN s ON lower(trim(text)) = q WHERE role = 'user'
""")
def saved_answer(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select("role", F.col("text").alias("question"), F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("answer")).where("role = 'user' and r2 = 'assistant'")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return retrieval.saved_answers(asked, pairs.select("question", "answer")).select("conv_id", "turn", F.sha2(F.coalesce("answer", F.lit("")), 256).alias("answer_sha"))


@query("SELECT doc_id, substr(sha256(text), 1, 20) AS key FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_key("text", 20).alias("key"))


@query("SELECT min(doc_id) AS doc_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY text")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("k"), F.char_length("text")).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n")).select("doc_id", "last_id", "n")


@query("SELECT arg_max(doc_id, doc_id) AS doc_id, min(doc_id) AS place FROM documents GROUP BY text")
def chunk_dedup(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("place"))
    return retrieval.dedup_chunks(chunks, F.sha2("text", 256), "place").select("doc_id", "place")


@query("""
WITH c AS (SELECT conv_id, turn, 'см. [стр. ' || conv_id || ', ' || turn || '–' || (turn + 2) || '] и [Стр. 7]' AS answer FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct([conv_id, turn, turn + 2, 7])), ',') AS cited, len(list_distinct(list_filter([conv_id, turn, turn + 2, 7], lambda x: x > 9)))::INT AS n_invalid, CASE WHEN len(list_filter([conv_id, turn, turn + 2, 7], lambda x: x > 9)) = 0 THEN 'pass' ELSE 'review' END AS qc FROM c
""")
def citation_qc(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    answer = F.concat(F.lit("см. [стр. "), s("conv_id"), F.lit(", "), s("turn"), F.lit("–"), (F.col("turn") + 2).cast("string"), F.lit("] и [Стр. 7]"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), F.sequence(F.lit(0), F.lit(9)).alias("valid"))
    return retrieval.answer_qc(rows, "answer", "valid").select("conv_id", "turn", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.size("invalid_citations").alias("n_invalid"), "qc")


BITS = "list_transform(range(1, 64), lambda i: (embedding[i + 1] > embedding[i])::INT)"


@query(f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, list_concat(embedding[1:8], [9.0::FLOAT], embedding[10:]) FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id, {BITS} AS b FROM v)
SELECT x.vec_id AS first, y.vec_id AS second, list_sum(list_transform(range(1, 64), lambda i: (x.b[i] <> y.b[i])::INT))::INT AS distance FROM b x JOIN b y ON x.vec_id < y.vec_id
WHERE list_sum(list_transform(range(1, 64), lambda i: (x.b[i] <> y.b[i])::INT)) <= 2
""")
def dhash_pairs(spark, sf_dir):
    """Pairs of difference hashes with at most 4 % differing bits, among vectors and retouched copies: of 63 bits in three blocks, such pairs agree on one."""
    items = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    touched = F.concat(F.slice("embedding", 1, 8), F.array(F.lit(9.0).cast("float")), F.slice("embedding", 10, 1000))
    items = items.unionByName(items.where("vec_id % 2 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), touched.alias("embedding")))
    bits = items.select("vec_id", G.rising_bits("embedding").alias("b"))
    rows = bits.select("vec_id", "b", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array_join(F.slice("b", i * 21 + 1, 21).cast("array<string>"), ""))).alias("t", "k"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    found = met.select(F.col("a.vec_id").alias("first"), F.col("b.vec_id").alias("second"), G.hamming("a.b", "b.b").alias("distance"))
    return found.where("distance <= 2").distinct()


@query("""
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS similarity FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query, vec_id, rank FROM (SELECT query, vec_id, (row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5
""")
def cosine_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(items, items.where("vec_id % 100 = 0"), "vec_id", "embedding").select("query", "vec_id", "rank")


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я-]{2,}')) AS t FROM conversations WHERE role = 'user'), q AS (SELECT conv_id, turn, unnest(t) AS t, len(t) AS n FROM t),
c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я-]{2,}'))) AS t FROM benchmark),
s AS (SELECT conv_id, turn, item_id, count(*) / max(n) AS w FROM q JOIN c USING (t) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY w DESC, item_id) AS r FROM s),
f AS (SELECT conv_id, turn, item_id, round(0.3 * 1.0 + 0.7 * w, 4) AS similarity FROM p WHERE r <= 64)
SELECT conv_id, turn, item_id, rank FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, item_id))::INT AS rank FROM f WHERE similarity >= 0.1) WHERE rank <= 8
""")
def hybrid_topk(spark, sf_dir):
    """Questions of the conversations against the benchmark's passages; all vectors are alike here, so words decide."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([0-9a-zа-я-]{2,})"), F.lit(1))
    one = F.array(F.lit(1.0), F.lit(0.0))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("q"), words("text").alias("t"), one.alias("v"))
    chunks = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("t"), one.alias("v"))
    return retrieval.hybrid(chunks, asked, "q", "t", "v", "item_id").select("q.conv_id", "q.turn", "item_id", "rank")


@query("SELECT conv_id, turn, length(trim(text)) BETWEEN 5 AND 1000 AS ok, rtrim(left(replace(text, chr(10), ' '), 500)) AS excerpt FROM conversations")
def question_guard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.question_ok("text").alias("ok"), T.excerpt("text").alias("excerpt"))


@query()
def greedy_dedup(spark, sf_dir):
    """Vectors of each label in order, each kept when no kept one before it differs in at most 40 % of its bits."""
    from ..operators.greedy import keep_first

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", G.rising_bits("embedding").alias("bits"))
    return keep_first(rows, "label", "vec_id", "bits", 0.4)


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я-]{2,}')) AS t FROM conversations WHERE role = 'user'), q AS (SELECT conv_id, turn, unnest(t) AS t, len(t) AS n FROM t),
c AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я-]{2,}'))) AS t FROM benchmark),
s AS (SELECT conv_id, turn, item_id, count(*) / max(n) AS w FROM q JOIN c USING (t) WHERE conv_id % 4 = 0 OR item_id % 5 = conv_id % 5 OR item_id % 5 = (conv_id + 2) % 5 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY w DESC, item_id) AS r FROM s),
f AS (SELECT conv_id, turn, item_id, round(0.3 * (1 + conv_id % 3 * (item_id % 4 + 0.3)) / sqrt(1 + (conv_id % 3) ** 2) / sqrt(1 + (item_id % 4 + 0.3) ** 2) + 0.7 * w, 4) AS similarity FROM p WHERE r <= 64)
SELECT conv_id, turn, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY similarity DESC, item_id) AS rank FROM f WHERE similarity >= 0.1) WHERE rank <= 8
""")
def scoped_search(spark, sf_dir):
    """Questions that search two of five documents, or all of them where no document is named (every fourth conversation)."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([0-9a-zа-я-]{2,})"), F.lit(1))
    vector = lambda x: F.array(F.lit(1.0), x.cast("double"))
    c = F.col("conv_id")
    scope = F.when(c % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(c % 5, (c + 2) % 5))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("q"), words("text").alias("t"), vector(c % 3).alias("v"), scope.alias("scope"))
    chunks = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("t"), vector(F.col("item_id") % 4 + 0.3).alias("v"), (F.col("item_id") % 5).alias("doc"))
    out = retrieval.hybrid(chunks, asked, "q", "t", "v", "item_id", document="doc", documents="scope")
    return out.select("q.conv_id", "q.turn", "item_id", "similarity")
