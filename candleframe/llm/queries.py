"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleframe.llm import ann, bpe, chatfmt, decontam, langid, linededup, minhash, ranked, secrets, substring, tokencount, toxicity, whiten
from candleframe.llm.common import shared_dir, ship, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return build(spark, sf_dir)

        run.__doc__, run.__name__ = build.__doc__, name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


RANKS = "byte_bpe_50k.tiktoken"


@register("op10_bpe_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole text to byte-level BPE ids, decode the ids, and return counts and digests."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(docs, "text", path, pattern).drop("text")
    back = bpe.decode(ids, "ids", path, pattern)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(key: str, modulus: int, rest: int):
    """crc32 of the key as text leaves ``rest``; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus == rest, F.lit(False))


@register("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    model = langid.fit(docs.filter(~F.col("held_out")), "text", "lang", F.col("doc_id"))
    return langid.predict(docs.drop("lang"), "text", model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@register("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text through a digest cache that this run starts empty."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    counted = tokencount.count_tokens(docs, "text", public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@register("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text through a blob ledger that this run starts empty."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, "text", shared_dir(spark, "blob-ledger"))
    kinds = [r.kind for r in secrets.BASE_RULES]
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in kinds]
    base = secrets.joined(F.col("spans"), tuple(kinds))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("spans"), tuple(kinds)).alias("spans"))


OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(regexp_replace(replace(text, '\', '\\'), '(\[/?(?:SYS|INST|ROLE)\]|\[/TURN\]|</?s>)', '\\\1', 'g')) AS n_text,
    length(regexp_replace(replace(role, '\', '\\'), '(\[/?(?:SYS|INST|ROLE)\]|\[/TURN\]|</?s>)', '\\\1', 'g')) AS n_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + n_role END)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM t GROUP BY conv_id
"""


@register("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings in its texts; read digests back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(tricky).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    return chatfmt.digests(chatfmt.format_turns(rows.unionByName(more)))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[k:k + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT a AS doc_id, a AS other FROM link
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


@register("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.near_duplicates(docs, "doc_id", "text", words=4, percent=80).withColumnRenamed("id", "doc_id")


#: A test item's text is cut at the first blank after its middle: question, answer.
CUT = "CASE WHEN instr(substring(text, 1 + length(text) DIV 2), ' ') > 0 THEN length(text) DIV 2 + instr(substring(text, 1 + length(text) DIV 2), ' ') ELSE length(text) END"


def test_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark", "item_id", "text")
    return rows.selectExpr("item_id", f"substring(text, 1, {CUT}) AS question", f"substring(text, 1 + {CUT}) AS answer")


OP8_SQL = r"""
WITH item AS (
  SELECT item_id, text, CASE WHEN strpos(substring(text, 1 + length(text) // 2), ' ') > 0
    THEN length(text) // 2 + strpos(substring(text, 1 + length(text) // 2), ' ') ELSE length(text) END AS cut FROM benchmark
), part AS (
  SELECT item_id, unnest(['whole', 'question', 'answer']) AS part,
    unnest([text, substring(text, 1, cut), substring(text, 1 + cut)]) AS text FROM item
), words AS (
  SELECT item_id, part, NULL AS doc_id, text FROM part UNION ALL SELECT NULL, NULL, doc_id, text FROM documents
), w AS (
  SELECT item_id, part, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM words
), s AS (
  SELECT DISTINCT item_id, part, doc_id, array_to_string(words[k:k + 4], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), size AS (
  SELECT item_id, part, count(*) AS n FROM s WHERE part IS NOT NULL GROUP BY ALL
), hit AS (
  SELECT d.doc_id, i.item_id, i.part, count(*) AS n FROM s i JOIN s d ON i.shingle = d.shingle
  WHERE i.part IS NOT NULL AND d.doc_id IS NOT NULL GROUP BY ALL
), wide AS (
  SELECT h.doc_id, h.item_id, max(h.n / z.n) FILTER (WHERE h.part = 'whole') AS overlap,
    coalesce(max(h.n / z.n) FILTER (WHERE h.part = 'question'), 0) AS question_overlap,
    coalesce(max(h.n / z.n) FILTER (WHERE h.part = 'answer'), 0) AS answer_overlap
  FROM hit h JOIN size z ON z.item_id = h.item_id AND z.part = h.part GROUP BY ALL
)
SELECT doc_id, item_id, overlap, question_overlap, answer_overlap FROM wide
WHERE overlap >= 0.8 AND question_overlap >= 0.5 AND answer_overlap >= 0.5
"""


@register("op8_decontamination", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items found in documents: retrieved by BM25 for every passage, verified by shared shingles."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.contaminated(docs, "doc_id", "text", test_items(spark, sf_dir), "item_id", "question", "answer")
    return found.select("doc_id", "item_id", "overlap", "question_overlap", "answer_overlap")


@register("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by its nearest labelled examples, learned from rows not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(~held_out("doc_id", 4, 2))
    # At most about toxicity.FIT_ROWS rows of 12 bytes: the sample is bounded, so it may be broadcast.
    sample = F.broadcast(toxicity.sample_labels(labels, F.col("doc_id"), "toxic"))
    examples = written(docs.join(sample, "doc_id").select("doc_id", "text", "toxic"), "toxicity-examples")
    scored = toxicity.score(docs, "text", toxicity.fit(examples, "doc_id", "text", "toxic"))
    evidence = F.transform("evidence", lambda e: e["id"]).alias("evidence")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"), evidence)


@register("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product for every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(rows, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, k - 1 AS line, lines[k] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), w AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS words FROM l
), c AS (
  SELECT words, any_value(list_transform(words, lambda x: hash(x))) AS hashes, len(words) AS n, min({'d': doc_id, 'l': line}) AS first FROM w WHERE len(words) > 0 GROUP BY words
), later AS (
  SELECT DISTINCT b.words FROM c a JOIN c b ON a.first < b.first AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  WHERE 180 * len(list_intersect(a.hashes, b.hashes)) >= 80 * (a.n + b.n)
), m AS (
  SELECT w.doc_id, w.line, coalesce(c.first <> {'d': w.doc_id, 'l': w.line} OR later.words IS NOT NULL, false) AS gone
  FROM w LEFT JOIN c ON c.words = w.words LEFT JOIN later ON later.words = w.words WHERE len(w.words) > 0
)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed, coalesce(x.removed, '') AS removed_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (WHERE gone) AS removed FROM m GROUP BY doc_id
) x ON x.doc_id = d.doc_id
"""


@register("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every whole text its lines with a word, and the numbers of those that an earlier line matches."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.select(F.col("doc_id").alias("id"), "text", linededup.doc_number("doc_id", "text").alias("doc"))
    found = docs.select("id", "doc").join(linededup.later_lines(docs, percent=80), "doc", "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return found.select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(F.transform(removed, lambda x: x.cast("string")), ",").alias("removed_lines"))


OP11_SQL = r"""
WITH w AS (
  SELECT 1 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 2, item_id, text FROM benchmark
), t AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM w
), d AS (
  SELECT id AS doc_id, term, count(*) AS tf FROM t WHERE side = 1 GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY doc_id
), c AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n
), q AS (
  SELECT DISTINCT id AS item_id, term FROM t WHERE side = 2 AND id IS NOT NULL
), g AS (
  SELECT term, floor(1000 * ln((2 * c.docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM d SEMI JOIN q USING (term) GROUP BY term), c
), s AS (
  SELECT q.item_id, d.doc_id, sum(g.weight * ((1000000000 * d.tf) // (1000 * d.tf + 20 * (100 - 50 + (50 * n.n * c.docs) // c.total))))::BIGINT AS score
  FROM q JOIN g USING (term) JOIN d USING (term) JOIN n USING (doc_id), c GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
"""


@register("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every test item, by hybrid evaluation over index blocks."""
    lists = ranked.build(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    found = ranked.search(lists, table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text", k=50)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


@register("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 16 leading components of the distinct ones, whitened."""
    return whiten.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", components=16)


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, k, md5(array_to_string(words[k:k + 34], ' ')) AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS k FROM t WHERE len(words) >= 35)
), twice AS (
  SELECT run FROM s GROUP BY run HAVING count(*) > 1
), cover AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM s SEMI JOIN twice USING (run)
), w AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM t
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM w ANTI JOIN cover USING (doc_id, k) GROUP BY doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


@register("op13_substring_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the words of runs of 35 that also start anywhere else."""
    docs = substring.keyed(table(spark, sf_dir, "documents", "doc_id", "text"), "text", "key")
    clean = substring.clean_texts(docs.select("key", "text"), "key", "text", words=35)
    digests = clean.select("key", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    return docs.select("doc_id", "key").join(digests, "key").drop("key")
