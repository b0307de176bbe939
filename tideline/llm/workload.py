"""The operators of this package run over the test tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.catalog import query, table
from tideline.llm.divergence import source_divergence
from tideline.llm.exact import exact_duplicates
from tideline.llm.leaks import find_leaks, n_hit
from tideline.llm.lines import line_report
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.periodic import collapse_runs, strongest
from tideline.llm.quality import quality_scores
from tideline.llm.sentence_pieces import encode_checked
from tideline.llm.substrings import remove_repeats
from tideline.llm.surrogates import replace_personal_data
from tideline.llm.token_counts import token_counts
from tideline.llm.top_k import top_k
from tideline.llm.training_order import read_ranks, write_training_order
from tideline.session import scratch_path

#: Where the vocabulary files of the public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"


@query(
    "op7_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents),
    w AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS seq
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)
    ),
    bad AS (
        SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY seq) AS least FROM w) WHERE least < doc_id
    ),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM bad),
    kept AS (
        SELECT d.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS text, count(*) AS n
        FROM d, (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) x
        WHERE x.doc_id = d.doc_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p)
        GROUP BY d.doc_id
    )
    SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """,
)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    "op10_decontamination",
    f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_LETTERS}') AS ws FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, least(len(ws), 10) AS n,
               unnest([array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') for i in range(1, greatest(len(ws) - 10, 0) + 2)]) AS seq
        FROM b WHERE len(ws) > 0
    ),
    place AS (
        SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS seq
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
    ),
    hit AS (SELECT doc_id, place.n AS n, i, item_id FROM place JOIN win ON place.seq = win.seq AND place.n = win.n),
    words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    items AS (
        SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id
    )
    SELECT d.doc_id, len(ws) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query(
    "op2_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_ngram_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id,
               unnest([array_to_string(ws[i:i + 2], ' ') for i in range(1, greatest(len(ws) - 2, 1) + 1)]) AS gram
        FROM d WHERE len(ws) > 0
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same
        FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
        WHERE 100 * same >= 90 * (p.n + q.n - same)
    ),
    edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM d
        UNION
        SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
    )
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id
    FROM d LEFT JOIN n USING (doc_id)
    """,
)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=90)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query("op6_sentence_pieces")
def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    done = encode_checked(table(spark, sf_dir, "documents"), model)
    return done.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        "round_trip",
    )


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_report(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The split pattern of the byte-pair vocabularies, a fixed value of theirs.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@query("op3_training_order")
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(tokenizer("byte_bpe_50k.tiktoken"), SPLIT_PATTERN)
    path = scratch_path(spark, "shards")
    _, written = write_training_order(table(spark, sf_dir, "documents"), path, ranks, 50256, key=b"epoch 0", length=512)
    return written


@query("op5_surrogates")
def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), key=b"surrogates").select("doc_id", "text", "n_replaced")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; one text in ten, by the CRC of its id, ends in a repeated stretch of its words."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def planted(w):
        n = F.nullif(F.size(w), F.lit(0)).cast("long")
        g = F.expr("crc div 10")
        a = g % n
        period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        # bound once: a lambda would compute them for each word
        bound = F.array(F.struct(w.alias("w"), a.alias("a"), period.alias("p")))
        old = lambda b, i: F.get(b["w"], (b["a"] + (i - b["a"]) % b["p"]).cast("int"))
        new = lambda b: F.array_join(F.transform(b["w"], lambda x, i: F.when(i >= b["a"], old(b, i)).otherwise(x)), " ")
        return F.transform(bound, new)[0]

    text = F.when(F.expr("crc % 10 = 0"), F.transform(F.array(words), planted)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", "text", crc.alias("crc")).select("doc_id", text.alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")), least=24)
    line = lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return done.select("doc_id", "runs", "text", strongest().alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
        FROM documents
    ),
    t AS (SELECT lang, source, doc_id, unnest(ws) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (
        SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, coalesce(any_value(v.v), 0) AS v
        FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
        LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source
    ),
    p AS (
        SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
               1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v) AS p
        FROM g JOIN kept ON kept.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
    ),
    q AS (
        SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(n) + 1)::HUGEINT) // (any_value(l.total) + any_value(l.v))::HUGEINT AS q
        FROM c JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY lang) l ON l.lang = c.lang
        GROUP BY c.lang, c.term
    ),
    pair AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(any_value(s.value), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
            FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        GROUP BY ALL
    ),
    term AS (
        SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value
        FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
    ),
    both_parts AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term' AS part, * FROM term)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
    ) WHERE part = 'pair' OR rank <= 200
    """,
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=3, top=200)


@query(
    "op13_top_k",
    """
    WITH e AS MATERIALIZED (
        SELECT vec_id, row_number() OVER () AS row, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ),
    s AS (
        SELECT q.row, q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
        FROM e q JOIN e x ON q.row <> x.row WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
    """,
)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), k=5, scale=256)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
