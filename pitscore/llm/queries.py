"""The numbered queries of this subpackage over the given tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.llm import chat, decontaminate, langid, near, ngram, pack, pii, quality, repeats, rules, trie, urls, variants
from pitscore.sources.io import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def fold(column: str = "doc_id"):
    """The remainder by five of the CRC-32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def quality_model(stats: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labelled documents outside the held-out fold."""
    return quality.fit(stats, quality.usable_labels(labels).where(fold() != 0))


def op1_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a model of the documents outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(F.coalesce(fold() != 1, F.lit(True))))
    return ngram.score(docs, model).select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    stats = materialize(quality.document_statistics(_table(spark, sf_dir, "documents")))
    model = quality_model(stats, _table(spark, sf_dir, "labels"))
    scored = quality.score(stats, model)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings that start earlier."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), with_kept=False)


#: The rules that the URL query is given: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Host labels whose pages make up the list of unwanted URLs.
UNWANTED_LABELS = ("spam-farm", "ads-track", "cheap-pills")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the list holds the canonical URLs of all pages on unwanted hosts."""
    pages = _table(spark, sf_dir, "pages")
    labels = F.split(urls.host(F.col("url")), r"\.")
    unwanted = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in UNWANTED_LABELS]))
    found = urls.judge(pages, pages.where(unwanted), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.of_kind(F.col("base"), k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    digest = F.sha2(pii.written(F.col("base")), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own marks, read back from the examples."""
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    marked = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(marked, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.expand(turns.union(extra)), streamed=True)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = near.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule verdicts of all documents, against references of their own languages."""
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def word_tokenizer() -> str:
    """Path of the public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack.pack(_table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False)


def piece_vocabulary() -> str:
    """Path of the public vocabulary of pieces."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model of those outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.train(docs.where(remainder != 2), piece_vocabulary())
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some runs of which lose a letter, with their near words, forms and roots."""
    words = variants.word_counts(_table(spark, sf_dir, "documents"), spoil=variants.SPOIL)
    return variants.variants(words)


def rebuilt(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the one whose id is the next lower multiple of five:
    h of them (the CRC-32 of its id modulo 9), then its own turns after its first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"), h.alias("h"))
    given = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("given"))
    convs = convs.join(given, "donor", "left")
    convs = materialize(convs.withColumn("shift", F.col("h") - F.least("h", F.coalesce("given", F.lit(0)))))
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "donor")  # h is at most 8
    first = heads.join(convs.select("conv_id", "donor", "h"), "donor").where("pos <= h")
    own = turns.where(F.col("pos") > h)
    own = trie.lookup(own, convs.select("conv_id", "shift"), ["conv_id"])
    own = own.withColumn("pos", F.col("pos") - F.col("shift"))
    return first.select(*turns.columns).unionByName(own.select(*turns.columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each rebuilt to share its first turns with others."""
    turns = materialize(trie.numbered(_table(spark, sf_dir, "conversations")))
    sizes = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("n")))
    found = trie.trie(materialize(rebuilt(turns, sizes)), sizes)
    return found.drop(*trie.ID)


QUERIES = {"op1_ngram": op1_ngram, "op2_quality": op2_quality, "op3_repeats": op3_repeats, "op4_urls": op4_urls, "op5_near_duplicates": op5_near_duplicates, "op6_rules": op6_rules, "op7_pack": op7_pack, "op8_pii": op8_pii, "op9_chat": op9_chat, "op10_decontaminate": op10_decontaminate, "op11_language": op11_language, "op12_variants": op12_variants, "op13_prefix_trie": op13_prefix_trie}

#: CRC-32 of a column of text, as DuckDB SQL: its table is built by the rule of the reflected polynomial.
CRC_TABLE = """(SELECT list(r ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT),
    [CAST(0 AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
    FROM range(256) t(i)))"""


def crc_sql(text: str) -> str:
    """Needs ``CRC_TABLE`` in scope as ``crc_table``."""
    codes = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS INT), 2) AS BIGINT))"
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"""


ORACLES = {
    "op12_variants": f"""
        WITH RECURSIVE k AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table),
        r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL),
        d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, n, {crc_sql("doc_id || ':' || run")} AS h FROM d, k),
        v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
              WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
              FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
        p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
              UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
        b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near,
                     first(n ORDER BY n DESC, near) AS m FROM p GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near,
                CASE WHEN b.m >= 10 * v.n THEN b.near END AS form, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n
              FROM v LEFT JOIN b USING (word)),
        w AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
              UNION ALL SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
        e AS (SELECT w.word, w.root FROM w JOIN f ON f.word = w.root WHERE f.form IS NULL)
        SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n
        FROM f LEFT JOIN e USING (word)""",
    "op13_prefix_trie": f"""
        WITH k AS MATERIALIZED (SELECT {CRC_TABLE} AS crc_table),
        t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id
                    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
        c AS MATERIALIZED (SELECT conv_id, n, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
              FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), k),
        r AS (SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t
                  ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
              UNION ALL
              SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(d.n, 0)), t.role, t.text
              FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
              LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 5),
        m AS MATERIALIZED (SELECT conv_id, pos AS depth, octet_length(encode(text)) AS n_bytes,
                sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
                       OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM r
              UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        p AS MATERIALIZED (SELECT *, lag(node) OVER w AS up, lead(node) OVER w IS NULL AS ends FROM m
              WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
        n AS MATERIALIZED (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(up) AS up,
                min(n_bytes) AS n_bytes,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), ''))
                    AS ends_sha256 FROM p GROUP BY node, depth),
        ch AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
        s AS (SELECT a.node, sum(CASE WHEN ch.node IS NULL THEN 1 ELSE 0 END) AS n_leaves,
                     sum((n.n_convs - 1) * n.n_bytes) AS saved_tokens
              FROM (SELECT DISTINCT a.node, b.node AS under FROM m a
                    JOIN m b ON a.conv_id = b.conv_id AND a.depth <= b.depth) a
              JOIN n ON n.node = a.under LEFT JOIN ch ON ch.node = a.under GROUP BY a.node)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs,
               coalesce(ch.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
               CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN s USING (node) LEFT JOIN ch USING (node) LEFT JOIN n q ON q.node = n.up""",
    "op10_decontaminate": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS k,
                array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS win
               FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM b
                     WHERE len(words) > 0)),
        dw AS (SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS win
               FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
                     FROM w CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)),
        h AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM dw d JOIN bw b ON d.k = b.k AND d.win = b.win),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
        m AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit,
               CAST(coalesce(len(m.items), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(m.items, ','), '')) AS items_sha256,
               coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op4_urls": r"""
        WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3)
                          ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_.*|ref|fbclid|gclid)(=.*)?$'))) AS params
              FROM h),
        c AS (SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
                     || regexp_replace(path, '(/index)?(\.html?)?/*$', '')
                     || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical
              FROM q),
        l AS (SELECT DISTINCT canonical FROM c
              WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'ads-track', 'cheap-pills'])
                AND canonical <> ''),
        rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
              ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        f AS (SELECT page_id, host, path, canonical,
                     (SELECT max_by({'v': verdict, 'r': rh || rp}, length(rh || rp)) FROM rules
                      WHERE (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp)) AS m
              FROM c)
        SELECT page_id, host, path, m.r AS rule,
               coalesce(m.v, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM f LEFT JOIN l USING (canonical)""",
    "op9_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
                     + list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '[ROLE]', '[/ROLE]'],
                         lambda c: (length(text) - length(replace(text, c, ''))) // length(c)))
                     + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length(role) END AS chars
              FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
