"""The queries ``op<N>_<name>``: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import chat, collocations, langid, linededup, mixing, neighbours, packing, quality, runs, sharding, simhash, toxicity, warc
from vocalith.llm.common import WHITE_CLASS, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the windows.  SHA-256 runs over a whole conversation, so its turns meet here."""
    control = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control)
    made = chat.windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))
    whole = (
        chat.read_turns(made)
        .groupBy("conv_id")
        .agg(
            F.sort_array(F.flatten(F.collect_list("turns"))).alias("t"),
            F.sort_array(F.flatten(F.collect_list("losses"))).alias("l"),
            F.sum("formatted_chars").cast("long").alias("formatted_chars"),
            F.count("*").alias("n_windows"),
        )
    )
    turns = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("l", lambda x: x.text), "")
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = warc.archive_dir(spark)
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), langid.train(table(spark, sf_dir, "documents")))


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.refused(quality.BASE).alias("base_failed"),
        (~quality.refused(quality.FULL)).alias("kept"),
        "n_lines",
        "fail_bits",
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def periodic_words(docs: DataFrame) -> DataFrame:
    """``docs`` in which the texts of one in ten are made periodic from one of their words on, as the contract of op11 has it."""
    h, words = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.filter(F.split(F.col("text").cast("string"), WHITE_CLASS), lambda w: w != "")
    n = F.size("_words")
    made = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    a = F.when(n > 0, F.col("_g") % n)
    made = made.withColumn("_a", a).withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    text = F.array_join(F.transform(at, lambda i: F.get("_words", i.cast("int"))), " ")
    return made.withColumn("text", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = runs.collapse(docs).withColumn("best", runs.strongest(F.col("runs")))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return made.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_kd_shards": op4_kd_shards,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_language": op6_language,
    "op7_pfair_mixing": op7_pfair_mixing,
    "op8_quality_ledger": op8_quality_ledger,
    "op9_toxicity": op9_toxicity,
    "op10_length_buckets": op10_length_buckets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_windows": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), r AS (
            SELECT *, (strlen(text) + 3) // 4 + 4 AS tok, row_number() OVER o AS pos,
                   role = 'system' AND coalesce(sum((role = 'system')::INT) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS sys,
                   8 + length(role) + 1 + 8 + length(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)),
                       '<|', '<' || chr(92) || '|'), '</s>', '<' || chr(92) || '/s>'), '<s>', '<' || chr(92) || 's>'), '[INST]', '[' || chr(92) || 'INST]'),
                       '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'), '<</SYS>>', '<' || chr(92) || '</SYS>>')) AS chars
            FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)
        ), s AS (SELECT conv_id, tok AS sys_tok, chars AS sys_chars FROM r WHERE sys),
        p AS (
            SELECT r.conv_id, pos, tok, chars, coalesce(sys_tok, 0) AS sys_tok, coalesce(sys_chars, 0) AS sys_chars,
                   greatest(1792 - coalesce(sys_tok, 0), 512) // 2 AS half,
                   coalesce(sum(tok) OVER (PARTITION BY r.conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM r LEFT JOIN s USING (conv_id) WHERE NOT sys
        ), w AS (
            SELECT conv_id, start // half AS bin, tok > half AS long, min(start) AS first, any_value(least(256, half)) AS back,
                   any_value(sys_chars) AS sys_chars, sum(chars) AS chars
            FROM p GROUP BY conv_id, start // half, tok > half
        ), h AS (
            SELECT w.conv_id, w.bin, w.long, sum(p.chars) AS chars
            FROM w JOIN p ON p.conv_id = w.conv_id AND p.start < w.first AND p.start >= w.first - w.back GROUP BY ALL
        ), f AS (
            SELECT conv_id, sum(w.chars + sys_chars + coalesce(h.chars, 0))::BIGINT AS formatted_chars, count(*) AS n_windows
            FROM w LEFT JOIN h USING (conv_id, bin, long) GROUP BY conv_id
        ), d AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256
            FROM r GROUP BY conv_id
        )
        SELECT d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
               coalesce(formatted_chars, sys_chars)::BIGINT AS formatted_chars, coalesce(n_windows, 1) AS n_windows
        FROM d LEFT JOIN f USING (conv_id) LEFT JOIN s USING (conv_id)
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
        ), five AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, i::INT * 5 + 1, 5))::BIGINT) AS v FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
                   lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> k) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM five
    """,
    "op8_quality_ledger": """
        WITH w AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
            FROM documents
        ), grams AS (
            SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
        ), cover AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                   (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                   coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
            FROM w LEFT JOIN cover USING (doc_id)
        ), bits AS (
            SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                       + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
                       + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
            FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
               fail_bits & 63 = 0 AS kept, n_lines, fail_bits
        FROM bits
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS ws
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
        ), grams AS (
            SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k)
        ), f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 100),
        cuts AS (
            SELECT c.lang, c.phrase, c.k, c.a, n.n, x.a AS l, y.a AS r, i,
                   (1000::HUGEINT * c.a * n.n // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN n USING (lang)
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.i], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.i + 1:], ' ')
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
        inner_ AS (
            SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS over
            FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k) GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE over IS NULL OR 100 * over < 100 * a
        QUALIFY rank <= 2000
    """,
    "op13_line_dedup": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (
            SELECT doc_id, row_, i, lines[i] AS line,
                   translate(trim(lines[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)
        ), f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN f USING (key) GROUP BY doc_id, row_
    """,
}
