"""Sentences, windows, chunks, hashes, layout and lexical queries over texts."""

from pyspark.sql import functions as F

from tracewright import views as V
from tracewright.catalogue import query
from tracewright.functions import scalars as S
from tracewright.operators import text as X
from tracewright.sources import documents as D
from tracewright.sources import models as N

SPACE = r"'[\x20\x09-\x0D]+'"
WORDS = f"list_filter(string_split_regex(text, {SPACE}), lambda x: x <> '')"
NS = "6ba7b8119dad11d180b400c04fd430c8"


@query()
def sentence_split(spark, sf_dir):
    """Sentences per document; the rule needs a lookahead that the checking engine lacks."""
    rows = X.sentence_spans(V.table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"), F.max("end").alias("last_end"))


@query(
    r"SELECT doc_id, (len(regexp_extract_all(text, '[0-9]+')) + len(list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))) + len(regexp_extract_all(text, '[$%]')))::INTEGER AS density FROM documents"
)
def information_density(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", S.information_density(F.col("text")).alias("density"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') AS canonical_hash FROM documents")
def content_hashes(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    canonical = S.canonical_hash(n_chars=F.col("n_chars").cast("string"), lang=S.ascii_json(F.col("lang")))
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), canonical.alias("canonical_hash"))


def _uuid_sql(digest: str) -> str:
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || substr('89ab', (('0x' || substr({digest}, 17, 1))::INTEGER % 4) + 1, 1) "
        f"|| substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


@query(
    f"WITH d AS (SELECT doc_id, n_chars, sha1(unhex('{NS}') || encode('document:' || doc_id)) AS h FROM documents), u AS (SELECT doc_id, n_chars, {_uuid_sql('h')} AS document FROM d), "
    "s AS (SELECT doc_id, document, sha1(unhex(replace(document, '-', '')) || encode('0:' || n_chars || ':0')) AS h FROM u) "
    f"SELECT doc_id, document, {_uuid_sql('h')} AS span_id FROM s"
)
def span_ids(spark, sf_dir):
    """Ids of the spans that cover their documents: uuid5 of the range and level in the namespace of the document's id."""
    d = V.table(spark, sf_dir, "documents").withColumn("document", D.document_uuid(F.col("doc_id")))
    return d.select("doc_id", "document", D.span_id(F.col("document"), F.lit(0), F.col("n_chars"), F.lit(0)).alias("span_id"))


def _windows_sql(size: int, overlap: int, align: bool) -> str:
    step = size - overlap
    start = f"w * {step}"
    if align:
        start = f"greatest(0, least({start}, n - {size}))"
    return (
        f"WITH d AS (SELECT doc_id, len({WORDS}) AS n FROM documents), x AS (SELECT doc_id, n, unnest(range(greatest(0, ceil((n - {size}) / {step}))::BIGINT + 1)) AS w FROM d WHERE n > 0) "
        f'SELECT doc_id, w::INTEGER AS "window", ({start})::BIGINT AS start, least(n, w * {step} + {size})::BIGINT AS "end" FROM x'
    )


def _tokens(spark, sf_dir):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda t: t != "")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n_tokens"))


@query(_windows_sql(256, 32, False))
def token_chunks(spark, sf_dir):
    return X.token_windows(_tokens(spark, sf_dir), 256, 32, False)


@query(_windows_sql(512, 128, True))
def embedding_windows(spark, sf_dir):
    return X.token_windows(_tokens(spark, sf_dir), 512, 128, True)


@query(
    f"WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents), x AS (SELECT *, unnest(range(greatest(0, ceil((len(words) - 256) / 224))::BIGINT + 1)) AS w FROM d WHERE len(words) > 0) "
    'SELECT doc_id, w::INTEGER AS "window", sha256(array_to_string(words[w * 224 + 1 : w * 224 + 256], \' \')) AS chunk_hash FROM x'
)
def chunk_texts(spark, sf_dir):
    return X.chunk_texts(V.table(spark, sf_dir, "documents"), 256, 32).select("doc_id", "window", F.sha2("chunk", 256).alias("chunk_hash"))


@query(
    "SELECT conv_id, turn, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')) AS context_hash FROM conversations"
)
def context_window(spark, sf_dir):
    out = X.context_windows(V.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.sha2("context", 256).alias("context_hash"))


@query(
    'SELECT conv_id, turn, (sum(length(text) + 2) OVER w - 2 - length(text))::BIGINT AS start, (sum(length(text) + 2) OVER w - 2)::BIGINT AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)'
)
def element_offsets(spark, sf_dir):
    out = X.char_ranges(V.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(
    """WITH e AS (SELECT conv_id, turn, (sum(length(text) + 2) OVER w - 2 - length(text)) AS s, (sum(length(text) + 2) OVER w - 2) AS e FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, max(e) AS n FROM e GROUP BY conv_id), sp AS (SELECT conv_id, unnest(range((n // 200)::BIGINT + 1)) AS span FROM t)
SELECT e.conv_id, span, count(*) AS elements, min(turn) AS first FROM sp JOIN e ON sp.conv_id = e.conv_id AND greatest(span * 200, s) < least(span * 200 + 200, e) GROUP BY ALL"""
)
def layout_overlap(spark, sf_dir):
    """Spans of 200 characters against the elements that they overlap."""
    e = X.char_ranges(V.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), "start", "end")
    total = e.groupBy("doc").agg(F.max("end").alias("n"))
    spans = total.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 200))).alias("span"))
    spans = spans.select("doc", "span", (F.col("span") * 200).alias("s_start"), (F.col("span") * 200 + 200).alias("s_end"))
    out = X.layout_overlap(spans, e)
    return out.select(F.col("doc").alias("conv_id"), "span", F.size("elements").cast("long").alias("elements"), F.array_min("elements").alias("first"))


@query(
    r"WITH l AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS lexeme FROM documents) "
    "SELECT doc_id, count(*) AS hits FROM l WHERE lexeme IN ('the', 'password', 'idiot') GROUP BY doc_id HAVING count(*) >= 2"
)
def lexical_lookup(spark, sf_dir):
    """Documents that hold at least two of the query's lexemes."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", S.lexemes(F.col("text")).alias("lexemes"))
    hits = F.size(F.array_intersect("lexemes", F.array(*map(F.lit, ("the", "password", "idiot")))))
    return d.select("doc_id", hits.cast("long").alias("hits")).where("hits >= 2")


@query("SELECT lang AS level, count(*) AS spans, count(CASE WHEN n_chars >= 500 THEN 1 END) AS texts, count(CASE WHEN n_chars < 500 THEN 1 END) AS missing FROM documents GROUP BY lang")
def counts_by_level(spark, sf_dir):
    from tracewright.operators.provenance import counts_by_level as counts

    d = V.table(spark, sf_dir, "documents")
    return counts(d.select(F.col("lang").alias("level"), F.when(F.col("n_chars") >= 500, F.lit("t")).alias("text")))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS token FROM documents WHERE doc_id % 2 = 1), h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h FROM t),
p AS (SELECT doc_id, h % 4 AS d, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM p GROUP BY doc_id),
e AS (SELECT doc_id, d, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS held FROM documents, (SELECT unnest(range(4)) AS d))
SELECT doc_id, 'new' AS model, d::INTEGER AS d, round(CASE WHEN doc_id % 2 = 0 THEN held WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE coalesce(x, 0.0) / n END, 6) AS x
FROM e LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id, d)"""
)
def reembedded(spark, sf_dir):
    """Vectors of another space embedded again with a deterministic stand-in; those of the new one stay as they were."""
    d = V.table(spark, sf_dir, "documents")
    model = F.when(F.col("doc_id") % 2 == 0, "new").otherwise("old")
    stored = F.array(*[F.lit(0.5)] * 4)
    out = D.reembed(d.select("doc_id", "text", model.alias("model"), stored.alias("vector")), "new", D.hash_embedder(4))
    return out.select("doc_id", "model", F.posexplode("vector").alias("d", "x")).withColumn("x", F.round("x", 6))


@query("SELECT doc_id, 'paragraph' AS kind, length(text) AS n FROM documents WHERE length(text) > 0")
def parsed_elements(spark, sf_dir):
    """Documents as bytes through the plain parser."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    out = D.parse_documents(d)
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "kind", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id AS document_id, 'reference' AS tier, sha256(text) AS input_sha256 FROM documents")
def sealed_corpus(spark, sf_dir):
    """Seals of the English documents, then of all: what was sealed must not have changed."""
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang")
    none = d.where("false").select("document_id", F.lit("").alias("tier"), F.lit("").alias("input_sha256"))
    return D.seal(D.seal(none, d.where("lang = 'en'").drop("lang")), d.drop("lang"))


@query(
    "SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'whitespace' WHEN doc_id % 7 = 0 THEN 'zero_vector' WHEN lang IS DISTINCT FROM 'en' THEN 'added' "
    "WHEN doc_id % 5 = 0 THEN 'conflict' ELSE 'known' END AS outcome FROM documents"
)
def persisted_spans(spark, sf_dir):
    """What an idempotent span sink makes of all spans when its store holds the English ones, every fifth with another text."""
    d = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("span_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end"), F.lit(0).alias("level"), "text",
        F.array(F.when(F.col("doc_id") % 7 == 0, 0.0).otherwise(1.0)).alias("vector"), "lang",
    )
    stored = d.where("lang = 'en'").drop("lang").withColumn("text", F.when(F.col("span_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    found = D.persist_spans(stored, d.drop("lang"))
    mark = lambda df, outcome: df.select(F.col("span_id").alias("doc_id"), outcome.alias("outcome"))
    told = mark(found.added, F.lit("added")).union(mark(found.skipped, F.col("reason"))).union(mark(found.conflicts, F.lit("conflict")))
    return told.union(mark(d.join(told.select(F.col("doc_id").alias("span_id")), "span_id", "left_anti"), F.lit("known")))


@query("SELECT conv_id AS question, count(DISTINCT turn) AS cited FROM conversations WHERE turn >= 1 AND turn <= 3 GROUP BY conv_id")
def citation_mapping(spark, sf_dir):
    """Cited passage numbers mapped to chunks; repeats and numbers out of range go."""
    c = V.table(spark, sf_dir, "conversations")
    chunks = c.select(F.col("conv_id").alias("question"), F.col("turn").cast("int").alias("number"), F.concat_ws("#", "conv_id", "turn").alias("chunk"))
    answers = c.select(F.col("conv_id").alias("question")).distinct().withColumn("cited", F.array(*map(F.lit, (1, 2, 2, 3, 99))))
    return N.cite(answers, chunks).groupBy("question").agg(F.count("*").alias("cited"))


@query(
    "SELECT conv_id, turn, 1::INTEGER AS items, true AS ok, sha256(trim(list_last(string_split(rtrim('extract:' || chr(10) || text, ' ' || chr(9) || chr(10) || chr(13)), chr(10))), ' ' || chr(9) || chr(13))) AS item "
    "FROM conversations WHERE text IS NOT NULL"
)
def guided_extraction(spark, sf_dir):
    """Guided calls to the deterministic stand-in model, parsed to their schema: the last line of each prompt."""
    c = V.table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.concat(F.lit("extract:\n"), "text").alias("prompt"))
    from pyspark.sql import types as T

    reply = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])
    out = N.guided_calls(c, "prompt", reply)
    return out.select("conv_id", "turn", F.size("reply.items").alias("items"), F.col("failure").isNull().alias("ok"), F.sha2(F.get("reply.items", 0)["text"], 256).alias("item"))
