"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.exact import exact_dedup
from pairwright.llm.fingerprints import compare_with_next
from pairwright.llm.lines import MIN_SITES, line_dedup
from pairwright.llm.lm import score_documents
from pairwright.llm.merge_dropout import decode_pieces, encode_pieces
from pairwright.llm.minhash import near_duplicates
from pairwright.llm.packing_fit import pack_texts
from pairwright.llm.projections import ALIKE, near_vectors
from pairwright.llm.quality import classify
from pairwright.llm.spelling import spelling_variants
from pairwright.llm.suffix import cut_repeats
from pairwright.llm.tables import read_table
from pairwright.llm.trie import nested, prefix_trie, rebuilt
from pairwright.llm.url_rules import judge_urls, rule_table

#: Rules (host, path, verdict) of the url query: given, fixed values.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Ids of <|startoftext|> and <|endoftext|> in word_bpe_49k.json: given, fixed values.
WORD_BPE_EDGES = (49406, 49407)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies; tasks ask again, for it lies with the worker's own libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = docs.withColumn("ids", encode_pieces(path, "text", F.col("doc_id")))
    decoded = encoded.withColumn("decoded", decode_pieces(path, "ids"))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.col("_n_cut").cast("long").alias("n_cut"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good. Background: all documents."""
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    start, end = WORD_BPE_EDGES
    return score_documents(read_table(spark, sf_dir, "documents"), good, tokenizer_file("word_bpe_49k.json"), start, end)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that share their first turns by hundreds."""
    nodes = prefix_trie(rebuilt(nested(read_table(spark, sf_dir, "conversations"))))
    return nodes.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_url_rules": op2_url_rules,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII or UTF-8 `text`, bit by bit: the SQL engine has no such function."""
    steps = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    pairs = f"[CAST('0x' || hex({text})[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, CAST(strlen({text}) AS BIGINT) + 1)]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {pairs}), lambda c, b: {steps}), 4294967295)"


ORACLES = {
    "op2_url_rules": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fits AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
            FROM parts JOIN rules
              ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND place = 1
    """,
    "op3_minhash_near_dedup": r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(words) = 1 THEN [md5(words[1])]
                                ELSE list_distinct([md5(words[i] || ' ' || words[i + 1]) FOR i IN range(1, len(words))]) END AS shingles
            FROM worded
        ), posted AS MATERIALIZED (
            SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
        ), common AS (
            SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n_u, any_value(b.n) AS n_v, count(*) AS shared
            FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
             AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id
        ), links AS MATERIALIZED (
            SELECT u, v FROM common WHERE 100 * shared >= 80 * (n_u + n_v - shared)
        ), reached AS (
            SELECT u AS a, u AS b FROM links UNION SELECT a, v FROM reached JOIN links ON u = b
        ), roots AS (
            SELECT a, min(b) AS root FROM reached GROUP BY a
        )
        SELECT doc_id, CAST(coalesce(len(shingles), 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id,
               coalesce(root, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN roots ON a = doc_id
    """,
    "op10_suffix_array_dedup": r"""
        WITH bytes AS MATERIALIZED (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
        ), pieces AS MATERIALIZED (
            SELECT doc_id, first, digits[2 * first + 1 : 2 * first + 718] AS piece
            FROM (SELECT doc_id, digits, unnest(range(0, strlen(digits) // 2, 260)) AS first FROM bytes)
        ), windows AS MATERIALIZED (
            SELECT doc_id, first + i AS start, md5(piece[2 * i + 1 : 2 * i + 200]) AS body
            FROM (SELECT doc_id, first, piece, unnest(range(least(260, strlen(piece) // 2 - 99))) AS i FROM pieces)
        ), later AS MATERIALIZED (
            SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM windows) WHERE place > 1
        ), opened AS (
            SELECT doc_id, start, coalesce(start > lag(start) OVER w + 100, true) AS opens FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY start)
        ), numbered AS (
            SELECT doc_id, start, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM opened
        ), spans AS (
            SELECT doc_id, span, min(start) AS a, max(start) + 100 AS b FROM numbered GROUP BY doc_id, span
        ), gaps AS (
            SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
            FROM spans GROUP BY doc_id
        ), kept AS (
            SELECT d.doc_id, strlen(digits) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
                   CASE WHEN g.doc_id IS NULL THEN digits
                        ELSE array_to_string([digits[2 * list_prepend(0, ends)[i] + 1 : 2 * list_append(starts, strlen(digits) // 2)[i]] FOR i IN range(1, n_spans + 2)], '') END AS rest
            FROM bytes d LEFT JOIN gaps g ON g.doc_id = d.doc_id
        )
        SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
    """,
    "op7_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op8_line_dedup": rf"""
        WITH cut AS (
            SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS place FROM cut
        ), trimmed AS (
            SELECT doc_id, source, place, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines
        ), spread AS (
            SELECT line, min(doc_id) AS first FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
        ), marked AS (
            SELECT t.doc_id, t.place, t.raw, s.line IS NOT NULL AND t.doc_id IS DISTINCT FROM s.first AS gone FROM trimmed t LEFT JOIN spread s ON t.line = s.line
        ), rebuilt AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_cut,
                   sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_cut, 0) AS n_cut,
               coalesce(kept_sha256, sha256('')) AS kept_sha256
        FROM documents d LEFT JOIN rebuilt USING (doc_id)
    """,
    "op11_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
            FROM documents
        ), counted AS MATERIALIZED (
            SELECT doc || ':' || run AS keyed, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
        ), hashed AS (
            SELECT run, n, {crc32_sql('keyed')} AS h FROM counted
        ), cut AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), without AS MATERIALIZED (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, w.word, w.n FROM without a JOIN words w ON w.word = a.rest
            UNION SELECT w.word, a.word, a.n FROM without a JOIN words w ON w.word = a.rest
        ), best AS (
            SELECT word, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS top FROM near GROUP BY word
        ), judged AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN -top.less >= 10 * w.n THEN top.form END AS form, CASE WHEN -top.less >= 10 * w.n THEN CAST(-top.less AS BIGINT) END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), chain AS (
            SELECT word, form AS root FROM judged WHERE form IS NOT NULL
            UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
        ), lasts AS (
            SELECT c.word, c.root FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NULL
        )
        SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN lasts l ON l.word = j.word
    """,
    "op12_conversation_trie": rf"""
        WITH ids AS MATERIALIZED (
            SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM ids
        ), rebuilt AS MATERIALIZED (
            SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
            FROM hashed a LEFT JOIN ids b ON b.conv_id = a.conv_id - a.conv_id % 100
        ), prefixes AS (
            SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
        ), keyed AS MATERIALIZED (
            SELECT conv_id, d, ends, sha256(CAST(to_json(path) AS VARCHAR)) AS node, sha256(CAST(to_json(path[1:d - 1]) AS VARCHAR)) AS parent,
                   CASE WHEN d > 0 THEN length(path[d][2]) ELSE 0 END AS size
            FROM prefixes
        ), nodes AS MATERIALIZED (
            SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM keyed GROUP BY d, node
        ), children AS MATERIALIZED (
            SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL
        ), under AS (
            SELECT DISTINCT k.d, k.node, b.d AS below_d, b.node AS below FROM keyed k JOIN keyed b ON b.conv_id = k.conv_id AND b.d >= k.d
        ), summed AS (
            SELECT u.d, u.node, count(*) FILTER (c.node IS NULL) AS n_leaves, CAST(sum(b.own) AS BIGINT) AS saved_tokens
            FROM under u JOIN nodes b ON b.d = u.below_d AND b.node = u.below LEFT JOIN children c ON c.d = b.d AND c.node = b.node
            GROUP BY u.d, u.node
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        FROM nodes n JOIN summed s ON s.d = n.d AND s.node = n.node
        LEFT JOIN children c ON c.d = n.d AND c.node = n.node LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.parent
    """,
    "op13_embedding_near_dedup": rf"""
        WITH RECURSIVE whole AS MATERIALIZED (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        ), sound AS MATERIALIZED (
            SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM whole
            WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= {ALIKE}
        ), reached AS (
            SELECT u AS a, u AS b FROM links UNION SELECT a, v FROM reached JOIN links ON u = b
        ), roots AS (
            SELECT a, min(b) AS root FROM reached GROUP BY a
        ), degrees AS (
            SELECT u, count(*) AS n FROM links GROUP BY u
        )
        SELECT w.vec_id, coalesce(n, 0) AS n_links, coalesce(root, w.vec_id) AS component_id, coalesce(root, w.vec_id) = w.vec_id AS kept
        FROM whole w LEFT JOIN roots r ON r.a = w.vec_id LEFT JOIN degrees d ON d.u = w.vec_id
    """,
}
