"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.llm import (
    chat, decontaminate, exact_dedup, language, mixing, prefix_trie, private_data, quality, secret_scan, simhash,
    suffix_dedup, toxicity, whitening,
)
from sigweave.llm.subword import held_out
from sigweave.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _hex(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kept_back = held_out(F.col("doc_id"), 5, 0)
    model = language.learn(docs, ~kept_back)
    rows = docs.select("doc_id", "text", kept_back.alias("held_out"))
    return language.predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs, 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept_back = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.learn(docs, labels.filter(~kept_back))
    rows = docs.withColumn("held_out", kept_back)
    return quality.scored(rows, model).select("doc_id", "held_out", "score", "predicted")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.learn(docs.select("doc_id", "text"), labels.filter(~held_out(F.col("doc_id"), 5, 0)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    scored = toxicity.scored(rows, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    read = chat.parse(chat.format_chats(turns.unionByName(extra)))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), _hex(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), _hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col("benchmark_hits")
    one = lambda h: F.concat_ws(":", *[h[c].cast("string") for c in ("item_id", "start_word", "end_word")])
    return found.select(
        "doc_id", (F.size(hits) > 0).alias("contaminated"), F.size(hits).cast("long").alias("n_items"),
        F.array_sort(hits["item_id"]).alias("item_ids"), F.coalesce(F.array_max(hits["similarity"]), F.lit(0.0)).alias("similarity"),
        F.concat_ws(",", F.transform(hits, one)).alias("hits"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.with_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs, size=3, radius=2).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in secret_scan.KINDS],
        _hex(secret_scan.joined(base)).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"),
        F.col("secrets_cut").alias("cut"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(turns)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(vectors).select("vec_id", *whitening.RESULT)


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in private_data.KINDS],
        _hex(private_data.joined(base)).alias("base_sha256"), private_data.joined(F.col("pii")).alias("spans"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_mix, op2_language, op3_suffix_dedup, op4_quality, op5_toxicity, op6_chat, op7_decontaminate, op8_exact_dedup,
        op9_simhash, op10_secrets, op11_prefix_trie, op12_whitening, op13_private_data,
    )
}

_ESCAPED = r"replace(replace(replace(text, '\', '\0'), '###', '\3'), '</turn>', '\e')"

# CRC-32 of the decimal digits of c, bit by bit.
_CRC32 = """xor(list_reduce(
        list_concat([4294967295::UBIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
        lambda a, b: list_reduce(
            list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
            lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)
    ), 4294967295::UBIGINT)"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": rf"""
        WITH said AS (
            SELECT conv_id AS c, [coalesce(role, ''), coalesce(text, '')] AS said,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
            FROM conversations WHERE conv_id IS NOT NULL
        ), chats AS (
            SELECT c, list(said ORDER BY k) AS said, list(words ORDER BY k) AS words, {_CRC32} % 4 AS h FROM said GROUP BY c
        ), whole AS (
            SELECT o.c,
                list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said,
                list_concat(coalesce(b.words[1:o.h], []), o.words[o.h + 1:]) AS words
            FROM chats o LEFT JOIN chats b ON b.c = o.c - o.c % 20
        ), paths AS (
            SELECT c, len(said) AS n, words,
                list_transform(range(0, len(said) + 1), lambda d: sha256(CAST(said[1:d] AS VARCHAR) || chr(10) || d)) AS ids
            FROM whole
        ), members AS (SELECT c, n, words, ids, unnest(range(0, n + 1)) AS depth FROM paths
        ), nodes AS (
            SELECT ids[depth + 1] AS id, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
                any_value(CASE WHEN depth > 0 THEN ids[depth] END) AS parent, arg_min(ids, c)[1:any_value(depth) + 1] AS above,
                any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
                sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = n), '')) AS ends_sha256
            FROM members GROUP BY ids[depth + 1]
        ), children AS (SELECT parent AS id, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
        ), sums AS (
            SELECT id, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
                SELECT unnest(above) AS id, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved
                FROM nodes LEFT JOIN children USING (id)
            ) GROUP BY id
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
            CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN sums USING (id) LEFT JOIN children USING (id) LEFT JOIN nodes p ON p.id = n.parent""",
    "op6_chat": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), pairs AS (
            SELECT *, lag(role) OVER w AS previous, lead(role) OVER w IS NULL AS final FROM turns
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(role) + length({_ESCAPED}) + 14) AS BIGINT) AS formatted_chars,
            bool_and(CASE WHEN previous IS NULL THEN role IN ('system', 'user')
                          WHEN role = 'user' THEN previous IN ('system', 'assistant')
                          WHEN role = 'assistant' THEN previous = 'user' ELSE false END
                     AND (NOT final OR role = 'assistant')) AS valid
        FROM pairs GROUP BY conv_id""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
